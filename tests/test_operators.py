from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators import corpus, governance, graph, observability, search, versions
from corpusmill.plans.ingest import distil
from corpusmill.streaming import logs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_percentiles_of_ten_and_twenty(spark):
    for n, low, high in ((10, 90, 100), (20, 190, 200)):
        rows = spark.range(1, n + 1).select(F.lit("p").alias("p"), (F.col("id") * 10).alias("ms"))
        assert observability.value_at(rows, ["p"], "ms", observability.LOWER_P95, "v").first()["v"] == low
        assert observability.value_at(rows, ["p"], "ms", observability.UPPER_P95, "v").first()["v"] == high


def test_catalog_weight_cases(spark):
    pairs = [("a/b", "a/b", 1.0), ("a/b/c", "a/b", 0.7), ("a/b", "a/c", 0.4), ("a/b", "x/y", 0.1), ("", "a/b", 0.5), (None, "a", 0.5)]
    for a, b, want in pairs:
        assert one(spark, scores.catalog_weight(F.lit(a).cast("string"), F.lit(b)))[0] == want


def test_fusion(spark):
    s = {"vector": F.lit(0.8), "graph": F.lit(0.6), "catalog": F.lit(0.5), "keyword": F.lit(0.9)}
    assert one(spark, scores.fused(s))[0] == round(0.35 * 0.8 + 0.25 * 0.6 + 0.15 * 0.5 + 0.25 * 0.9, 4)


def test_tokens_join_cjk_over_gaps(spark):
    assert one(spark, text.search_tokens(F.lit("Grid 电 x 网 a1 bc")))[0] == ["grid", "bc", "电网", "电", "网"]
    assert one(spark, text.search_tokens(F.lit(None).cast("string")))[0] == []


def test_similarities(spark):
    a = one(spark, text.edit_similarity(F.lit(""), F.lit("")), text.edit_similarity(F.lit("abcd"), F.lit("abce")), text.charset_jaccard(F.lit("abc"), F.lit("bcd")), scores.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    assert tuple(a) == (1.0, 0.75, 0.5, 0.0)


def test_noise(spark):
    assert one(spark, corpus.noise_ratio(F.lit("收到\n[10:30] 张三: 好的\n+1\n方案已经更新到第三版\n\n")))[0] == 0.75
    assert one(spark, corpus.noise_ratio(F.lit("")))[0] == 1.0


def test_boundary_chunks_against_plain_python(spark):
    texts = {1: "one. two! three? " * 60, 2: None, 3: "x" * 1200, 4: "a。" + "b" * 700, 5: " " * 600}
    got = {}
    for r in corpus.boundary_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["start"], r["content"]))
    assert set(got) == {1, 3, 4}
    for i, pieces in got.items():
        pieces.sort()
        for (_, s, c), (_, s2, _) in zip(pieces, pieces[1:], strict=False):
            assert s2 == s + len(c) - 100 if s + 500 < len(texts[i]) else s2 == s + 400
        assert all(texts[i][s : s + len(c)] == c for _, s, c in pieces)
        assert pieces[-1][1] + len(pieces[-1][2]) == len(texts[i])
    assert all(c.endswith((".", "!", "?")) for _, _, c in got[1][:-2])


def test_roles(spark):
    read = lambda u, ud, d, dd: one(spark, governance.may_read(F.lit(u), F.lit(ud).cast("string"), F.lit(d), F.lit(dd).cast("string")))[0]
    assert read("secret", "x", "CONFIDENTIAL", "x") and read("secret", None, "CONFIDENTIAL", "x")
    assert not read("secret", "y", "CONFIDENTIAL", "x") and not read("public", "x", "internal", "x")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.bm25(docs, spark.createDataFrame([(1, "a b")], "query_id long, query string")).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert corpus.exact_duplicates(docs).count() == 0


def test_hops_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (4, 1)], "a long, b long")
    near = {r["node"]: r["hops"] for r in graph.hops(edges, spark.createDataFrame([(1,)], "node long"), 4).collect()}
    assert near == {1: 0, 2: 1, 4: 1, 3: 2}
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_upsert_keeps_columns(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, title string, v long")
    out = versions.upsert(table, spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "id long, title string, v long"), ["id"], keep=["title"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (2, "b", 9), (3, "d", 3)]
    assert versions.insert_if_absent(table, table.withColumn("v", F.lit(5).cast("long")), ["id"]).count() == 2


def test_distil(spark):
    docs = spark.createDataFrame([(1, "token " * 200), (2, "ok"), (3, "plain text here")], "doc_id long, text string")
    judged = spark.createDataFrame([(1, 9.0, 0, 0.0, "KEEP", 0.9), (3, 9.0, 0, 0.0, "DISCARD", 0.9)], "doc_id long, density double, age long, redundancy double, proposed string, confidence double")
    rules = spark.createDataFrame([("access", 1, ["token"])], "domain_id string, priority int, keywords array<string>")
    out = distil(docs, judged, rules, spark.createDataFrame([], "doc_id long, hash string")).collect()
    assert {(r["doc_id"], r["domain_id"]) for r in out} == {(1, "access")} and len(out) == 3


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=20 * i), 10 * i, i % 3 > 0) for i in range(12)]
    spark.createDataFrame(rows, "query_id long, at timestamp, total_ms long, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, at timestamp, total_ms long, ok boolean").parquet(str(tmp_path / "in"))
    for name, df, mode in (("buckets", logs.ingest_buckets(stream), "complete"), ("first", logs.unseen(stream, ["ok"], "at"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r["total"], r["success"]) for r in spark.table("buckets").collect()) == [(3, 2)] * 4
    assert spark.table("first").count() == 2


def test_sessions_go_on_over_midnight(spark):
    at = [datetime(2024, 1, 1, 23, 50) + timedelta(minutes=m) for m in (0, 5, 9, 14, 18, 40, 60)] + [datetime(2024, 1, 2, 23, 58), datetime(2024, 1, 3, 0, 8), datetime(2024, 1, 3, 0, 17)]
    log = spark.createDataFrame([("p", t) for t in at], "project string, at timestamp_ntz")
    rows = [(r["started"], r["n"]) for r in observability.sessions(log, ["project"], "at").orderBy("started").collect()]
    assert rows == [(at[0], 5), (at[5], 1), (at[6], 1), (at[7], 1), (at[8], 2)]


def test_versions_are_carried_over_days(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    versions_ = spark.createDataFrame([(1, "c", day(1), day(3)), (2, "c", day(3), day(3)), (3, "c", day(3), None), (4, "d", day(2), day(4))], "version_id long, condition string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    made = [("c", day(1), "approved"), ("c", day(2, 5), "rejected"), ("c", day(3), "pending"), ("c", day(9), "approved"), ("d", day(1), "approved"), ("d", day(3, 23), "approved"), ("d", day(4), "approved"), (None, day(3), "approved")]
    out = observability.ab_scores(spark.createDataFrame(made, "condition string, at timestamp_ntz, status string"), versions_, "condition")
    assert {tuple(r) for r in out.collect()} == {(1, 2, 1, 1, 0.5), (2, 0, 0, 0, 0.0), (3, 2, 1, 0, 1.0), (4, 1, 1, 0, 1.0)}


def test_nearest_in_blocks_and_deep_trees(spark):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    queries = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one_pass, many = (sorted(map(tuple, search.nearest(vectors, queries, k=3, block=b).collect())) for b in (100, 4))
    assert one_pass == many and len(many) == 14 * 3
    tree = spark.createDataFrame([(f"n{k}", f"n{k - 1}") for k in range(1, 19)] + [("n0", "n18")], "id string, parent string")
    assert governance.descendants(tree, "n0").count() == 19


def test_boundary_chunks_end_at_marks(spark):
    docs = spark.createDataFrame([(1, "a" * 450 + ". " + "b" * 100 + "!" + "c" * 700), (2, None), (3, ""), (4, " " * 600), (5, "x" * 480 + "。" + "." * 30)], "doc_id long, text string")
    rows = {(r["doc_id"], r["chunk_index"], r["start"], len(r["content"])) for r in corpus.boundary_chunks(docs).collect()}
    assert {r for r in rows if r[0] == 1} == {(1, 0, 0, 451), (1, 1, 351, 500), (1, 2, 751, 500), (1, 3, 1151, 102)}
    assert {r for r in rows if r[0] == 5} == {(5, 0, 0, 481), (5, 1, 381, 130)} and {r[0] for r in rows} == {1, 5}

"""What the third review found, at tiny sizes."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue_parsed, catalogue_tables
from corpusmill.llm import ngram_lm, quality_rules
from corpusmill.llm.common import let
from corpusmill.operators import chunks, communities, corpus, graph, keyword_index, search
from corpusmill.operators.documents import module_stats, parent_child_chunks, redact_documents


@pytest.mark.parametrize("few", [1, 5, 1000])
def test_shared_entities_deal_pairs_by_their_number(spark, few):
    rows = [(d, e) for e in range(12) for d in range(e, 40, e % 5 + 1)] * 2
    want = {}
    for e in range(12):
        for pair in combinations(sorted({d for d, x in rows if x == e}), 2):
            want[pair] = want.get(pair, 0) + 1
    out = graph.shared_entities(spark.createDataFrame(rows, "doc long, entity long"), pairs_a_task=few)
    assert {(r["a"], r["b"]): r["n_shared"] for r in out.collect()} == want
    if few == 5:  # many more tasks than the session's four partitions, and not made fewer
        assert out.rdd.getNumPartitions() > 400
    assert graph.shared_entities(spark.createDataFrame([], "doc long, entity long")).collect() == []


def test_module_stats_deal_imports_by_their_number(spark):
    modules = spark.createDataFrame([(f"m{i}",) for i in range(20)] * 2, "module string")
    edges = [(f"m{i % 7}", f"m{i * 5 % 33}") for i in range(300)]
    pairs = {(a, b) for a, b in edges if a != b and int(b[1:]) < 20}
    out = module_stats(modules, spark.createDataFrame(edges, "source string, target string"), ["m1"], rows_a_task=3)
    got = {r["module"]: (r["in_degree"], r["out_degree"]) for r in out.collect()}
    assert got == {f"m{i}": (sum(b == f"m{i}" for _, b in pairs), sum(a == f"m{i}" for a, _ in pairs)) for i in range(20)}


def test_all_labels_are_used_however_they_are_joined(spark):
    n = 20_050  # more than were taken before
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    sample = ngram_lm.labelled_sample(labels.union(labels.limit(5)), F.col("quality") == 1)
    assert sample.count() == n and sample.where("__good").count() == n - -(-n // 3)
    docs = spark.range(0, 2 * n, 50).select(F.col("id").alias("__id"), F.lit("a b").alias("t"))
    few, many = (docs.join(ngram_lm.beside(sample, most), "__id", "left") for most in (n, 0))
    assert sorted(few.collect()) == sorted(many.collect()) and few.where("__good is not null").count() == 401


def test_redaction_numbers_spans_inside_their_row(spark):
    rows = [(1, "张工和王主任问李工,张工说重5kg"), (None, "李总"), (1, "李总"), (2, None)]
    texts, tokens = redact_documents(spark.createDataFrame(rows, "doc_id long, text string"), ["北方"], precision="EXACT")
    assert sorted(map(tuple, texts.collect()), key=str) == sorted([(1, "工程师A和管理者A问工程师B,工程师A说重5kg"), (None, "管理者A"), (1, "管理者A"), (2, None)], key=str)
    assert tokens.count() == 7
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()


def test_semantic_chunks_look_cosines_up(spark):
    docs = spark.createDataFrame([(1, [f"{c * 60}." for c in "abcdefghi"]), (2, ["one."]), (3, None), (4, ["x" * 200 + ".", "y" * 200 + ".", "z."])], "doc_id long, s array<string>")
    angle = lambda k: [math.cos(k / 2), math.sin(k / 2)]
    given = {k: angle(k) for k in range(500) if k != (4 * 31 + 0) % 500} | {31: [0.0, 0.0]}
    out = catalogue_tables.chunk_sizes(docs, spark.createDataFrame(list(given.items()), "vec_id long, embedding array<float>"))
    want = {}
    for id, s in [(1, ["a" * 61] * 9)]:
        v = [given[(id * 31 + i // 3 * 7) % 500] for i in range(len(s))]
        dots = [sum(p * q for p, q in zip(x, y)) for x, y in zip(v, v[1:])]
        edges = [0, *chunks.cuts([len(x) for x in s], dots), len(s)]
        want[id] = ",".join(str(61 * (b - a)) for a, b in zip(edges, edges[1:]))
    assert dict(map(tuple, out.collect())) == want  # all of the fourth's sentences lack a vector


def test_parents_and_children_are_cut_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "# a\n" + "x. " * 150 + "\n## b\nshort"), (2, None), (3, " \n "), (4, "one\n\n\ntwo")], "doc_id long, text string")
    out = parent_child_chunks(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(out.collect(), key=lambda r: (r["doc_id"], r["chunk_index"]))
    assert [(r["doc_id"], r["chunk_index"], r["is_parent"]) for r in rows] == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True), (1, 4, False), (4, 0, True), (4, 1, False), (4, 2, True), (4, 3, False)]
    assert "".join(r["content"] for r in rows[1:3]) == rows[0]["content"] and rows[1]["parent_chunk_id"] == rows[0]["chunk_id"]


def test_quality_rules_cut_a_text_once_for_words_and_score(spark):
    rows = [(1, "a b a b\x0bc  d"), (2, None), (3, " \n"), (4, "x"), (5, "one two three four five six one two three four five $#")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = F.transform(F.sequence(F.lit(1), F.lit(ngram_lm.BUCKETS)), lambda x: (x * 7 % 1001 - 500).cast("int"))
    table = spark.range(1).select(ratios.alias("ratios")).localCheckpoint()
    w, symbols, _ = quality_rules.base_rules(F.col("text"), F.col("ratios"))
    out = docs.withColumn("ratios", table.scalar()).select("doc_id", w, symbols)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(text") == 1
    array = table.first()[0]
    buckets = docs.select("doc_id", let(ngram_lm.hashes_of(F.col("text")), ngram_lm.buckets_of).alias("b"))
    sums = {r["doc_id"]: sum(array[i] for i in r["b"]) for r in buckets.collect()}
    for r in out.collect():
        words = (dict(rows)[r["doc_id"]] or "").split()
        assert (r["w"]["n_words"], r["w"]["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["w"]["score"] == (sums[r["doc_id"]] // len(words) if words else None)
    assert {r["doc_id"]: (r["w"]["n_repeat_words"], r["n_symbols"]) for r in out.collect()}[5] == (10, 2)


def test_best_keyword_scores_are_dealt_by_pairs(spark):
    docs = [(i, f"{'aa ' * (i % 4)}{'bb ' * (i % 3)}cc") for i in range(40)]
    postings = [(i, len(t.split()), w, t.split().count(w)) for i, t in docs for w in sorted(set(t.split()))]
    df = [(w, sum(p[2] == w for p in postings)) for w in ("aa", "bb", "cc")]
    frames = [spark.createDataFrame(postings, "doc_id long, length long, term string, tf long"), spark.createDataFrame(df, "term string, df long")]
    terms = spark.createDataFrame([(1, "aa", 1), (1, "cc", 2), (2, "bb", 1), (3, "zz", 1)], "query_id long, term string, times long")
    only = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in range(0, 40, 3)], "query_id long, doc_id long")
    few, many = (search.ranked_scores(*frames, F.broadcast(terms), F.lit(40), F.lit(3.0), None, only, pairs_a_task=n) for n in (2, 10**6))
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() > 0
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression [doc_id#" in x and x.rstrip().endswith(str(-(-sum(n for _, n in df) // 2))) for x in plan.splitlines()), plan


def test_a_round_of_communities_joins_its_edges_once(spark):
    edges = [(a, b, 1) for a in range(8) for b in range(a) if a // 4 == b // 4] + [(3, 4, 1)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a long, b long, w long")
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("label", F.floor(F.col("node") / 4).cast("long") * 4)
    near = communities._near(both, nodes)
    assert {(r["node"], r["label"]): r["w"] for r in near.collect()} == {(n, c): sum(w for a, b, w in edges + [(b, a, w) for a, b, w in edges] if a == n and b // 4 * 4 == c) for n in range(8) for c in (0, 4) if c == n // 4 * 4 or n in (3, 4)}
    assert communities._score(near, nodes, 0, 26) == 24 * 26 - 2 * 13**2
    many = spark.createDataFrame([(a, b, w * 10**9) for a, b, w in edges], "a long, b long, w long")  # gains beyond a long
    few = spark.createDataFrame(edges, "a long, b long, w long")
    assert sorted(communities.communities(few, 4, 2).collect()) == sorted(communities.communities(many, 4, 2).collect())


def test_texts_are_cut_beside_a_documents_blocks(spark, tmp_path):
    rows = [(1, "One. " * 300, "en", "s", 1500), (5, None, "de", "s", 0), (6, "a b c d", "en", "t", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue_parsed.multimodal_chunks(spark, str(tmp_path))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    texts = corpus.boundary_chunks(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = texts.select("doc_id", "chunk_index", F.sha2("content", 256)).collect()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in out.where("strategy = 'fixed'").select("doc_id", "chunk_index", "content_sha256").collect())
    for id in (1, 5, 6):
        places = sorted(r[0] for r in out.where(F.col("doc_id") == id).select("chunk_index").collect())
        assert places == list(range(len(places)))


def test_segments_that_join_are_written_once(spark, tmp_path):
    index, written = keyword_index.KeywordIndex(spark, str(tmp_path)), []
    write = index._write
    index._write = lambda *a: written.append(1) or write(*a)
    for part in ([(i, "aa bb") for i in range(6)], [(6, "aa cc"), (7, "bb")], [(8, "aa bb"), (9, "cc dd")]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    assert len(written) == 3 and [(s["n_docs"], s["n_tokens"], s["n_postings"]) for s in index.segments()] == [(10, 19, 19)]

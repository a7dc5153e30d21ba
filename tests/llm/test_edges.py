"""Nulls in any column, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, resample, secret_scan, substring_dedup, token_files
from corpusmill.llm.common import fresh_path
from corpusmill.llm.encoding import tokenizer_path

DOCS = "doc_id long, text string, lang string, n long"
LABELS = "doc_id long, quality int, toxic int"
LINE = "a line that two documents share"
ROWS = [(1, LINE + "\nown", "en", 1), (1, LINE + "\nown", "en", 1), (2, LINE, None, None), (None, LINE, "en", 2), (3, None, "en", 3), (4, "", None, None), (5, "x " * 400, "de", 5)]
CLASH = ["secrets", "blob", "contamination", "line_dedup", "quality", "resample", "key", "score", "part", "shingle", "id", "a", "b", "kept", "a.b", "__pos", "__score", "__q", "__ratios", "pos", "row", "of", "found", "ratios", "__id", "__text", "hit", "PII", "x`y"]


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, 0), (5, 1, None), (1, 1, 0)], LABELS)
    bench = spark.createDataFrame([(7, LINE), (None, "x x x"), (8, None), (9, "")], "item_id long, text string")
    return labels, bench


def operators(spark, tables):
    labels, bench = tables
    word, byte = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")

    def files(d):
        folder = fresh_path(spark, "tokens")
        return token_files.read_token_files(token_files.write_token_files(d, folder, byte), folder)

    return {
        "pii": pii.find_pii, "secrets": lambda d: secret_scan.scan_versions(d, fresh_path(spark, "ledger")), "contamination": lambda d: decontaminate.contamination(d, bench, mask=True), "files": files,
        "join": ngram_join.jaccard_components, "substrings": substring_dedup.dedup_substrings, "packing": lambda d: packing.pack(d, word), "quality": lambda d: quality_rules.quality_rules(d, labels),
        "lines": line_dedup.drop_shared_lines, "resample": lambda d: resample.importance_resample(d, labels),
    }


NAMES = ["pii", "secrets", "contamination", "files", "join", "substrings", "packing", "quality", "lines", "resample"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_whole(spark, tables, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    for c in CLASH:
        docs = docs.withColumn(c, F.when(F.col("n") > 1, F.lit("own")))
    out = operators(spark, tables)[name](docs).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, name):
    assert operators(spark, tables)[name](spark.createDataFrame([], DOCS)).count() == 0


def test_lines_and_rows_without_id(spark):
    out = {(r["doc_id"], r["text"]) for r in line_dedup.drop_shared_lines(spark.createDataFrame(ROWS, DOCS)).collect()}
    assert {(1, LINE + "\nown"), (2, ""), (None, ""), (3, None), (4, "")} <= out


def test_resampling_draws_k_largest(spark, tables):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7).alias("text"))
    out = resample.importance_resample(docs, tables[0], k=123).select("resample.*").collect()
    kept = sorted(r["key"] for r in out if r["kept"])
    assert len(kept) == 123 and kept[0] > max(r["key"] for r in out if not r["kept"])


def test_ledger_scans_only_unseen(spark):
    ledger, docs = fresh_path(spark, "ledger"), spark.createDataFrame([(1, "token: abcdefghijklmnop"), (2, "x")], "doc_id long, text string")
    first = secret_scan.scan_versions(docs, ledger).collect()
    again = secret_scan.scan_versions(docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10)), ledger).collect()
    assert spark.read.parquet(ledger).count() == 2 and len(first) == 2 and sum(bool(r["secrets"]["base"]) for r in again) == 2


def test_ledger_with_a_blob_twice(spark):
    ledger, docs = fresh_path(spark, "ledger"), spark.createDataFrame([(1, "token: abcdefghijklmnop"), (2, "x")], "doc_id long, text string")
    secret_scan.scan_versions(docs, ledger).count()
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    assert secret_scan.scan_versions(docs, ledger + "2").count() == 2


def test_contamination_in_blocks(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    one, many = ({r["doc_id"]: r["contamination"] for r in decontaminate.contamination(docs, bench, mask=True, block_bytes=b).collect()} for b in (1 << 20, 2000))
    assert one == many and any(c["n_hit"] for c in one.values())


def test_addresses_of_letters_are_found_whatever_else_the_text_holds(spark):
    rows = [(i, t + more) for i, (t, more) in enumerate((t, m) for t in ("host dead:beef:cafe:babe:feed:face:bead:fade", "mail ann [at] example [dot] org") for m in ("", " 7"))]
    out = {r["doc_id"]: len(r["pii"]["spans"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == out[1] and out[2] == out[3] == 1


def test_file_reads_some_and_notices_damage(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}", tokenizer_path("byte_bpe_50k.json"), frame_bytes=64)
    assert {r["doc_id"] for r in token_files.read_token_files(manifest, f"file://{tmp_path}", [3, 7]).collect()} == {3, 7}
    name = manifest.first()["file"]
    raw = bytearray((tmp_path / name).read_bytes())
    raw[20] ^= 0xFF
    (tmp_path / name).write_bytes(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.read_file(f"file://{tmp_path}", name))


def test_pipeline_keeps_columns(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert p.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_drops_copies(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in p.STAGES[2][1](spark, docs, sf).select("doc_id").collect()}
    assert {3, 5, 8} - left == set() or {1003, 1005, 1008} - left == {1003, 1005, 1008}
    assert not {1003, 1005, 1008} & left

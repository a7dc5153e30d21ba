"""Versioned tables and chunks by meaning: repeated batches, failures, shadows, and the plain loop."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.operators import chunks
from corpusmill.sources.snapshots import VersionedTable
from corpusmill.sources.tables import fresh_path

PAGES = "page long, project string, seq long, text string"


def rows(t):
    return {(r["page"], r["project"]): (r["seq"], r["text"], r["version"]) for r in t.read().collect()}


@pytest.fixture
def table(spark):
    return VersionedTable(spark, fresh_path(spark, "pages"), PAGES, ["page", "project"], 4)


def frame(spark, *data):
    return spark.createDataFrame(list(data), PAGES)


def test_a_batch_that_comes_twice_changes_nothing(spark, table):
    assert table.version() == 0 and table.read().count() == 0
    first = frame(spark, (1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, None), (None, "a", 1, "lost"))
    assert table.upsert(first, ["seq"], "s", 0) == 1
    assert rows(table) == {(1, "a"): (2, "y", 1), (1, "b"): (1, None, 1)}
    assert table.upsert(first, ["seq"], "s", 0) == 1 == table.version()
    table.upsert(frame(spark, (1, "a", 3, "z"), (2, "a", 1, "n")), ["seq"], "s", 1)
    table.upsert(frame(spark, (1, "a", 3, "z")), ["seq"], "s", 0)
    assert rows(table) == {(1, "a"): (3, "z", 2), (1, "b"): (1, None, 1), (2, "a"): (1, "n", 1)}
    table.upsert(frame(spark, (2, "a", 9, "other")), ["seq"], "another", 0)
    assert rows(table)[2, "a"] == (9, "other", 2) and table.upsert(frame(spark).limit(0), stream="s", batch=2) == 4
    assert {r["text"] for r in table.read(1).collect()} == {"y", None}


def test_what_a_failed_commit_wrote_is_never_read(spark, table):
    table.upsert(frame(spark, (1, "a", 1, "x")), stream="s", batch=0)
    broken = VersionedTable(spark, table.path, PAGES, ["page", "project"], 4)

    def fails(*_):
        raise RuntimeError("lost")

    broken._commit = fails
    with pytest.raises(RuntimeError):
        broken.upsert(frame(spark, (1, "a", 2, "bad"), (7, "q", 1, "bad")), stream="s", batch=1)
    assert rows(table) == {(1, "a"): (1, "x", 1)}
    table.upsert(frame(spark, (1, "a", 2, "good")), stream="s", batch=1)
    assert rows(table) == {(1, "a"): (2, "good", 2)}


def test_two_writers_at_once(spark, table):
    table.upsert(frame(spark, (1, "a", 1, "x")))
    other = VersionedTable(spark, table.path, PAGES, ["page", "project"], 4)
    stale = other._entries()
    table.upsert(frame(spark, (1, "a", 2, "y")))
    other._entries = lambda version=None: stale
    with pytest.raises(Exception, match="already exists"):
        other.upsert(frame(spark, (1, "a", 3, "z")))
    assert rows(table) == {(1, "a"): (2, "y", 2)}


def test_a_stream_into_the_table(spark, table, tmp_path):
    for k in range(3):
        frame(spark, *[(i, "a", k, f"t{k}") for i in range(k, 4)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):  # the second run starts from nothing and sends all batches again
        source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = source.writeStream.foreachBatch(table.sink("pages", ["seq"])).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert {k[0]: v[2] for k, v in rows(table).items()} == {0: 1, 1: 2, 2: 3, 3: 3}


def test_history_closes_intervals(spark):
    t = VersionedTable(spark, fresh_path(spark, "prompts"), "prompt string, valid_from timestamp, valid_to timestamp, text string", ["prompt"], 2)
    day = lambda n: datetime(2024, 1, n)
    give = lambda *x: spark.createDataFrame([(p, day(n), None, s) for p, n, s in x], t.schema)
    t.append_history(give(("p", 3, "c"), ("p", 1, "a"), ("q", 5, "z")), "s", 0)
    t.append_history(give(("p", 2, "b"), ("p", 3, "C")), "s", 1)
    t.append_history(give(("p", 2, "b"), ("p", 3, "C")), "s", 1)
    got = [(r["prompt"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day, r["text"], r["version"]) for r in t.read().orderBy("prompt", "valid_from").collect()]
    assert got == [("p", 1, 2, "a", 1), ("p", 2, 3, "b", 2), ("p", 3, None, "C", 3), ("q", 5, None, "z", 1)]


def test_shadow_swap_rollback(spark, table):
    table.upsert(frame(spark, (1, "a", 1, "main"), (2, "a", 1, "main")), stream="s", batch=0)
    assert not table.swap() and table.rollback() is None and not table.cancel_shadow() and table.shadow() is None
    table.begin_shadow(frame(spark, (1, "a", 1, "gone")))
    assert table.cancel_shadow() and table.shadow() is None
    table.begin_shadow(frame(spark, (1, "a", 2, "shadow"), (9, "z", 1, "shadow")))
    assert {r["text"] for r in table.shadow().collect()} == {"shadow"} and {r["text"] for r in table.read().collect()} == {"main"}
    table.upsert(frame(spark, (3, "a", 1, "meanwhile")), stream="s", batch=1)
    before = rows(table)
    assert table.swap() and rows(table) == {(1, "a"): (2, "shadow", 1), (9, "z"): (1, "shadow", 1)}
    assert table.upsert(frame(spark, (3, "a", 1, "again")), stream="s", batch=1) == table.version()  # streams go on where they were
    assert table.rollback() is not None and rows(table) == before
    assert table.rollback() is None


def test_a_swap_that_fails_leaves_the_table_as_it_was(spark, table):
    table.upsert(frame(spark, (1, "a", 1, "main")))
    table.begin_shadow(frame(spark, (1, "a", 2, "shadow")))
    broken = VersionedTable(spark, table.path, PAGES, ["page", "project"], 4)
    broken._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.swap()
    assert rows(table) == {(1, "a"): (1, "main", 1)} and table.swap() and rows(table) == {(1, "a"): (2, "shadow", 1)}


def loop(sentences, vectors, threshold=0.5, least=100, most=1500):
    out, cur = [], [sentences[0]]
    for k in range(len(sentences) - 1):
        a, b = vectors[k], vectors[k + 1]
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        alike = float(a @ b / (na * nb)) if na and nb else 0.0
        size = sum(map(len, cur))
        if (alike < threshold and size >= least) or size + len(sentences[k + 1]) > most:
            out.append("".join(cur))
            cur = []
        cur.append(sentences[k + 1])
    return [c for c in [*out, "".join(cur)] if c.strip()]


def test_semantic_chunks_equal_the_loop(spark):
    draw = random.Random(12)
    topics = [["cat", "dog", "pet", "fur"], ["tax", "law", "court", "fee"]]
    texts = []
    for i in range(40):
        said = [" ".join(draw.choices(draw.choice(topics), k=draw.randint(1, 30))).capitalize() + draw.choice([". ", "! ", "\n"]) for _ in range(draw.randint(0, 30))]
        texts.append((i, "".join(said)))
    texts += [(100, None), (101, "  \n "), (102, "One sentence only."), (103, "?! .\n" * 5), (104, "x" * 2000 + ". " + "y" * 2000 + ". z.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    embed, got = chunks.hashed_words(32), {}
    for r in chunks.semantic_chunks(docs, R.sentences(F.col("text")), embed).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    own = {r["doc_id"]: r["s"] for r in docs.select("doc_id", R.sentences(F.col("text")).alias("s")).collect()}
    assert got == {i: loop(s, embed(s)) for i, s in own.items() if len(s) > 1}
    assert any(len(c) > 1 for c in got.values())
    plan = chunks.chunks_by_strategy(docs, F.when(F.col("doc_id") % 2 == 0, "Semantic"), R.sentences(F.col("text")), embed, 500, 100)
    by = {}
    for r in plan.collect():
        by.setdefault(r["doc_id"], set()).add(r["strategy"])
    assert by[102] == {"fixed"} and 100 not in by and 101 not in by and by[104] == {"semantic"} and by[1] == {"fixed"}


def test_embeddings_are_the_same_every_time():
    a, b = chunks.seeded_vectors(16), chunks.hashed_words(16)
    assert np.array_equal(a(["x", "y"]), a(["x", "y"])) and np.allclose(np.linalg.norm(a(["x"]), axis=1), 1)
    assert np.allclose(b(["one two"]), b(["two ONE"])) and not b(["..."]).any()

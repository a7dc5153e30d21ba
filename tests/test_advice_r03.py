"""Cases of the review's third round: memory that doesn't grow with the table, and joins that stay as large as their results."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusmill.operators import names, observability, vectors


def test_a_task_of_the_exact_search_holds_tiles_only():
    """F1 to F5, F9: scores of all queries of a block with all vectors of a batch were one matrix."""
    draw = np.random.default_rng(7)
    table = [(i, v) for i, v in enumerate(draw.normal(size=(4000, 16)).tolist())]
    table += [(4000 + i, table[5][1]) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in table]), pa.array([v for _, v in table])], names=["id", "vector"])
    run, _ = vectors._best(table[:3000], 10, None, "long", "long")
    tracemalloc.start()
    found = [r for b in run(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(found) == 30_000
    unit = np.array([v for _, v in table])
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    got = {}
    for q, i, s in found:
        got.setdefault(q, []).append((-s, i))
    for q in (0, 5, 1234, 2999):
        score = np.round(np.clip(unit @ unit[q], 0, 1), 6)
        assert [i for _, i in sorted(got[q])] == [i for i in np.lexsort((np.arange(len(unit)), -score)).tolist() if i != q][:10]


def test_lists_of_queries_are_bits_and_places_are_found_in_tiles():
    """each query of a block held a set of all its lists."""
    draw = np.random.default_rng(8)
    units, centroids = draw.normal(size=(6000, 4)), draw.normal(size=(500, 4))
    tracemalloc.start()
    near = vectors._nearest_lists(units, centroids, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.dtype == np.int32 and peak < 100 << 20
    assert (near == np.argsort(-np.round(units @ centroids.T, 12), axis=1, kind="stable")).all()
    assert (vectors._nearest_lists(units, centroids, 1)[:, 0] == near[:, 0]).all()


def test_recall_in_groups_makes_no_pairs_of_a_group(spark):
    """the truth was a row for each query and member of its group."""
    members = spark.createDataFrame([(i, i % 3 if i < 30 else None) for i in range(33)] + [(40, 9)], "doc_id long, group int")
    queries = members.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    got = spark.createDataFrame([(0, 3, 1), (0, 4, 2), (0, 31, 3), (5, 6, 1), (5, 8, 2), (30, 31, 1), (40, 1, 1)], "query_id long, doc_id long, rank int")
    truth = queries.join(members, "group").where("doc_id <> query_id").select("query_id", "doc_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = observability.recall_in_groups(members, queries, got, [1, 3])
    assert rows(found) == rows(observability.recall_report(truth, got, [1, 3])) and found.count() == 12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (group" not in plan or "Aggregate [group" in plan


def test_titles_are_compared_with_leaders_only(spark, monkeypatch):
    """all alike titles were joined with each other by single characters, before anyone led."""
    monkeypatch.setattr(names, "ROUND", 7)
    draw = np.random.default_rng(9)
    titles = [(i, "".join(draw.choice(list("abcdefghij北方é"), size=draw.integers(0, 9)))) for i in range(150)] + [(150, None), (151, "abc"), (152, "cab")]
    leaders, want = [], {}
    for i, t in titles:
        own = set(t or "")
        found = next((j for j, other in leaders if own and len(own & other) / len(own | other) >= 0.6), i)
        want[i] = found
        if found == i:
            leaders.append((i, own))
    df = spark.createDataFrame(titles, "at long, title string").repartition(3)
    assert dict(names.greedy_clusters(df, 0.6).collect()) == want and len(leaders) > 30
    assert names.greedy_clusters(df.limit(0)).count() == names.greedy_clusters(df.where("at = 150")).count() - 1 == 0


def test_grams_are_made_once_for_texts_of_one_name(spark, monkeypatch):
    """the grams of every text were shuffled with the text."""
    texts = spark.createDataFrame([(i, ("Alpha beta", "gamma", None, "Beta-max")[i % 4]) for i in range(40)], "id long, name string")
    needles = spark.createDataFrame([(1, "beta"), (2, "MA"), (3, "zz"), (4, ""), (5, None), (6, "a b")], "id long, name string")
    written, plain = {}, names.saved
    monkeypatch.setattr(names, "saved", lambda df, name: written.setdefault(name, plain(df, name)))
    want = sorted([(1, i) for i in range(40) if i % 4 in (0, 3)] + [(2, i) for i in range(40) if i % 4 in (1, 3)] + [(6, i) for i in range(40) if i % 4 == 0])
    assert sorted(map(tuple, names.containing(needles, texts).collect())) == want
    assert written["names"].count() == 3
    written.clear()
    monkeypatch.setattr(names, "BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, names.containing(needles, texts).collect())) == want

"""Edits of taxonomies: each command, undo beyond its snapshots, and odd rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import taxonomy as T

BASE = f"taxonomy string, position long, node {T.NODE}, op string"
LOG = "taxonomy string, position long, op string, targets array<string>, names array<string>, ids array<string>, node int"
KIDS = {"a": [("k1", "K1"), ("k2", "K2")], "b": [("k2", "other"), ("k3", "K3")], "c": None}


@pytest.fixture
def after(spark):
    def run(*commands, taxonomies=("t",)):
        base = [(t, i, (n, n.upper(), 2, n, KIDS[n]), "x") for t in taxonomies for i, n in enumerate("abc")]
        out = T.edited_trees(spark.createDataFrame(base, BASE), spark.createDataFrame([(*c, None) for c in commands], LOG))
        rows = sorted(out.collect(), key=lambda r: (r["taxonomy"] or "", r["place"]))
        return {t: [(r["id"], r["name"]) for r in rows if r["taxonomy"] == t] for t in {r["taxonomy"] for r in rows}}, rows

    return run


def test_text_commands(spark):
    said = ["删除 A", "把 A 改成 B", "新增：海外", "去掉:新增", "  ", None, "随便", "将A重命名为B，好", "移除 A 再添加 B"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", T.text_command(F.col("s")).alias("c")).orderBy("i").collect()
    assert [(r.c.op, list(r.c.targets), list(r.c.names)) for r in got] == [
        ("remove", ["A"], []), ("rename", ["A"], ["B"]), ("add", [], ["海外"]), ("remove", ["新增"], []), (None, [], []), (None, [], []), (None, [], []), ("rename", ["A"], ["B"]), ("remove", ["A"], []),
    ]


def test_each_command(after):
    _, rows = after(("t", 1, "merge", ["a", "b", "zz"], ["A & B"], None))
    assert [(r["id"], r["name"], r["description"]) for r in rows] == [("c", "C", "c"), ("a___b", "A & B", "合并自 A / B")]
    assert [(k["id"], k["name"]) for k in rows[1]["children"]] == [("k1", "K1"), ("k2", "K2"), ("k3", "K3")]
    assert after(("t", 1, "merge", ["a", "zz"], ["M"], None))[0]["t"] == [("a", "A"), ("b", "B"), ("c", "C")]
    assert after(("t", 1, "merge", ["a", "c"], ["北"], ["m"]))[0]["t"] == [("b", "B"), ("m", "北")]
    assert after(("t", 1, "split", ["a"], ["X", "北", ""], ["x9"]))[0]["t"] == [("b", "B"), ("c", "C"), ("x9", "X"), ("_", "北")]
    assert after(("t", 1, "split", ["A"], ["X"], None))[0]["t"] == [("a", "A"), ("b", "B"), ("c", "C")]
    assert after(("t", 1, "rename", ["b"], ["A"], None), ("t", 2, "remove", ["A"], None, None))[0]["t"] == [("c", "C")]
    assert after(("t", 1, "add", None, ["C"], None), ("t", 2, "add", None, ["D e"], None))[0]["t"] == [("a", "A"), ("b", "B"), ("c", "C"), ("d_e", "D e")]


def test_undo_goes_back_twenty_commands(after):
    adds = [("t", i, "add", None, [f"n{i}"], None) for i in range(25)]
    undos = [("t", 100 + i, "undo", None, None, None) for i in range(30)]
    assert [n for _, n in after(*adds, *undos)[0]["t"]] == ["A", "B", "C", *(f"n{i}" for i in range(5))]
    assert after(*undos[:3], *adds[:0])[0]["t"] == [("a", "A"), ("b", "B"), ("c", "C")]
    nothing = ("t", 50, "remove", ["zz"], None, None)  # a command without effect is undone as one
    assert [n for _, n in after(*adds[:2], nothing, undos[0])[0]["t"]][3:] == ["n0", "n1"]
    assert [n for _, n in after(*adds[:2], ("t", 50, "other", None, None, None), ("t", 51, None, None, None, None), undos[0])[0]["t"]][3:] == ["n0"]


def test_odd_rows(after, spark):
    got, _ = after(("t", 1, "add", None, None, None), ("t", 2, "rename", [None], ["x"], None), (None, 1, "add", None, ["N"], None), ("t", None, "add", None, ["first"], None), ("u", 1, "remove", ["a"], None, None), taxonomies=("t", "u", "gone"))
    assert got["t"] == [("a", "A"), ("b", "B"), ("c", "C"), ("first", "first")] and got[None] == [("n", "N")] and got["u"] == [("b", "B"), ("c", "C")] and len(got["gone"]) == 3
    assert "gone" not in after(*[("gone", i, "remove", [n], None, None) for i, n in enumerate("abc")], taxonomies=("gone",))[0]
    empty = spark.createDataFrame([], LOG)
    assert T.edited_trees(spark.createDataFrame([], BASE), empty).count() == 0


def test_a_log_over_many_batches(after, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        log = [(t, i, "add", None, [f"{t}{i}"], None) for i in range(9) for t in "tuv"] + [("u", 50, "undo", None, None, None)]
        got, _ = after(*log, taxonomies=("t", "u"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [n for _, n in got["t"]] == ["A", "B", "C", *(f"t{i}" for i in range(9))]
    assert [n for _, n in got["u"]] == ["A", "B", "C", *(f"u{i}" for i in range(8))] and [n for _, n in got["v"]] == [f"v{i}" for i in range(9)]

"""Spans of texts with very many of them, against regular expressions in plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from corpusmill.llm import pii, secret_scan
from corpusmill.llm.spans import running


def test_running(spark):
    draw = random.Random(1)
    rows = [([draw.randint(-5, 5) for _ in range(n)],) for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 1000)]
    out = spark.createDataFrame(rows, "v array<int>").select("v", running(F.col("v"), lambda a, b: a + b).alias("sum"), running(F.col("v"), F.greatest).alias("max")).collect()
    for r in out:
        assert r["sum"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]
        assert r["max"] == [max(r["v"][: k + 1]) for k in range(len(r["v"]))]


def test_fifty_thousand_secrets_of_one_text_take_seconds(spark):
    text = " ".join(f"token: abcdefghijkl{k:06d} x" for k in range(50_000))
    began = time.time()
    base, spans = secret_scan.secret_spans(F.col("text"))
    r = spark.createDataFrame([(text,)], "text string").select(base.alias("base"), F.size(spans).alias("n")).first()
    assert [(s["start"], s["stop"]) for s in r["base"]] == [m.span() for m in re.finditer(r"token: [a-z0-9]+", text)] and r["n"] == 50_000
    assert time.time() - began < 60


def test_fifty_thousand_personal_spans_of_one_text(spark):
    text = " ".join(f"mail a{k}@b.org or tel. 030-123-{k % 9000 + 1000} (bob{k} (at) host [dot] com)" for k in range(25_000))
    began = time.time()
    r = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()
    base = [m.span() for m in re.finditer(pii.EMAIL.replace("\\G|", ""), text)]
    assert [(s["start"], s["stop"]) for s in r["pii"]["base"]] == base and len(base) == 25_000
    assert len(r["pii"]["spans"]) >= 50_000
    stops = [0, *[s["stop"] for s in r["pii"]["spans"]]]
    assert all(s["start"] >= before for s, before in zip(r["pii"]["spans"], stops, strict=False))
    assert time.time() - began < 120


def test_candidates_that_touch_base_spans_or_better_ones_go(spark):
    draw = random.Random(7)
    kind = "array<struct<start:int,kind:int,stop:int,match:string,before:string>>"
    rows = []
    for n in range(200):
        spans = lambda most: sorted((a := draw.randint(0, 300), draw.randint(0, 3), a + draw.randint(7, 40), "m" * draw.randint(1, 9), "") for _ in range(draw.randint(0, most)))
        rows.append((n, spans(6), spans(12)))
    trees = [(1.0, (2, 4.0, 0.5, (2, 7.0, 2.0, 1.0)))]
    score = lambda s: 0.5 if len(s[3]) <= 4 else 2.0 if len(s[3]) <= 7 else 1.0
    out = spark.createDataFrame(rows, f"n int, b {kind}, m {kind}").select("n", pii.select_spans(F.col("b"), F.col("m"), trees, [0.0, 0.6, 0.0, 1.5]).alias("s")).collect()
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    for r in out:
        _, base, more = rows[r["n"]]
        free = [c for c in more if score(c) >= [0.0, 0.6, 0.0, 1.5][c[1]] and not any(meets(c, b) for b in base)]
        rank = lambda c: (-score(c), c[0], c[1])
        want = sorted(base + [c for c in free if not any(meets(c, o) and rank(o) < rank(c) for o in free)])
        assert [tuple(s) for s in r["s"]] == want

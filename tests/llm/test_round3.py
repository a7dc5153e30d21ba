"""Fill-in-middle, periodic runs and repeated windows against plain Python, the split paths and odd inputs too."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fill_in_middle as fim
from corpusmill.llm import periodic_runs, repeated_windows
from corpusmill.llm.registry import QUERIES

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
run = lambda name, spark, sf: {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_op11(spark, sf, texts):
    got, forms = run("op11_fill_in_middle", spark, sf), Counter()
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        t = t or ""
        units, h = re.findall(r"[^\n]*\n|[^\n]+", t), hashlib.sha256(f"7:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not t or re.search("<[PSM]>", t) else "spm" if h4 % 100 < 50 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        forms[form] += 1
        want = (i, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(t))
        assert tuple(got[i]) == want, i
    assert len(forms) == 3


def test_op11_restores_any_text(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices(["<", "P", "S", "M", ">", "\n", "é", "\r"], k=draw.randint(0, 30)))) for i in range(3000)] + [(None, "a\nb"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fim", F.lit("own"))
    out = fim.fill_in_middle(docs).collect()
    assert all(r["fim"]["restored_sha256"] == sha(r["text"] or "") and r["fim"]["output_sha256"] == sha(r["fim"]["output"]) for r in out)
    assert len(out) == len(rows) and all(fim.restored(r["fim"]["output"], r["fim"]["form"]) == (r["text"] or "") for r in out)
    other = fim.fill_in_middle(docs, unit=r"\S+\s*|\s+", seed=8, rate=30, spm_rate=100).collect()
    assert {r["fim"]["form"] for r in other} == {"plain", "spm"} and all(r["fim"]["restored_sha256"] == sha(r["text"] or "") for r in other)


def smallest_period(w):
    border = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k]
        k += w[i] == w[k]
        border[i + 1] = k
    return len(w) - border[len(w)]


def all_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        s = None
        for i in range(len(w) - q + 1):
            same = i + q < len(w) and w[i] == w[i + q]
            if same and s is None:
                s = i
            elif not same and s is not None:
                n = i + q - s
                if n >= max(least, exponent * q) and smallest_period(w[s : s + n]) == q:
                    out.append((s, n, q))
                s = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    for n in range(1, 9):
        for w in product((0, 1, 2) if n < 7 else (0, 1), repeat=n):
            assert periodic_runs.stretch_runs(list(w), 2, 2) == all_runs(w, 2, 2), w
    draw = random.Random(1)
    for _ in range(400):
        letters, w = draw.randint(1, 3), []
        while len(w) < draw.randint(1, 220):
            piece = [draw.randrange(letters) for _ in range(draw.randint(1, 12))]
            w += piece * draw.randint(1, 9)
        for least, exponent in ((24, 3), (2, 2), (10, 4)):
            want = all_runs(w, least, exponent)
            assert periodic_runs.stretch_runs(w, least, exponent) == want
            assert periodic_runs.text_runs([[b"x"], [b"%d" % x for x in w], []], least, exponent)[1] == want
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    assert periodic_runs.stretch_runs(fib[-1], 2, 2) == all_runs(fib[-1], 2, 2)


def test_runs_with_hashes_that_collide(monkeypatch):
    monkeypatch.setattr(periodic_runs, "MODULUS", 3)
    draw = random.Random(2)
    for _ in range(60):
        w = [x for _ in range(8) for x in [draw.randrange(3) for _ in range(draw.randint(1, 6))] * draw.randint(1, 6)]
        assert periodic_runs.stretch_runs(w, 6, 2) == all_runs(w, 6, 2)


def test_long_periodic_texts_take_no_square_of_steps():
    for w in ([0] * 200_000, [0, 1, 2, 3, 4] * 40_000, list(range(50_000)) * 4):
        assert periodic_runs.stretch_runs(w) == [(0, 200_000, len(set(w)))]


def test_op12(spark, sf, texts):
    got, some = run("op12_periodic_runs", spark, sf), 0
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = split(t)
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = all_runs(w, 24, 3) if len(w) < 1500 or h % 10 == 0 or len(set(w)) < 10 else periodic_runs.text_runs([[x.encode() for x in w]], 24, 3)[0]
        some += bool(runs)
        gone = {k for s, n_, q in runs for k in range(s + q, s + n_)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[i]
        want = (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert tuple(r) == want, i
    assert some > 5


def test_op12_keeps_all_rows(spark):
    rows = [(1, "a b " * 20 + "c " * 30), (1, "a b " * 20 + "c " * 30), (None, None), (3, ""), (4, " x "), (None, "y " * 24)]
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("PERIODICITY", F.lit(1)))
    got = {(r["doc_id"], r["text"]): r["periodicity"] for r in out.collect()}
    assert out.count() == 6 and out.columns == ["doc_id", "text", "periodicity"]
    assert [tuple(x) for x in got[1, rows[0][1]]["runs"]] == [(0, 40, 2), (40, 30, 1)] and got[1, rows[0][1]]["collapsed"] == "a b c"
    assert got[None, "y " * 24]["collapsed"] == "y" and got[None, None]["collapsed"] == "" and got[4, " x "]["n_words"] == 1


def brute_windows(rows):
    """{row: (n_words, n_removed, kept)} of (id, text) rows."""
    words = [split(t) for _, t in rows]
    times = Counter(tuple(w[j : j + 35]) for w in words for j in range(len(w) - 34))
    out = []
    for w in words:
        gone = {p for j in range(len(w) - 34) if times[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_op13(spark, sf, texts):
    got = run("op13_substring_dedup", spark, sf)
    assert got.keys() == texts.keys()
    want = dict(zip(texts, brute_windows(texts.items()), strict=True))
    for i, (n, gone, kept) in want.items():
        assert tuple(got[i]) == (i, n, gone, sha(kept)), i
    assert sum(x[1] > 0 for x in want.values()) > 5


def odd_rows(n=500):
    """Passages in differing surroundings, copies, near copies, periodic texts, repeated ids and nulls."""
    draw = random.Random(11)
    passages = [[f"p{draw.randrange(40)}" for _ in range(draw.randint(30, 90))] for _ in range(6)]
    common = ["the", "common", "phrase", "here"]
    rows = []
    for i in range(n):
        w = [f"w{draw.randrange(300)}" for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            w += p[draw.randint(0, 5) : len(p) - draw.randint(0, 5)] + common + [f"w{draw.randrange(300)}" for _ in range(draw.randint(0, 50))]
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, *rows[:3], (None, rows[5][1]), (None, None), (9001, ""), (9002, "z " * 300), (9003, "é" * 200 + " " + "long" * 50 + " q" * 60), (9004, " ".join(f"u{k}" for k in range(34)))]


@pytest.mark.parametrize(("pack", "bucket"), [(1 << 21, 500_000), (20_000, 3_000), (5_000, 400), (3_000, 8)])
def test_op13_in_packs_buckets_and_hot_windows(spark, monkeypatch, pack, bucket):
    monkeypatch.setattr(repeated_windows, "LONGEST", 50)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(1)).repartition(3)
    out = repeated_windows.drop_repeated_windows(docs, with_kept=True, pack_bytes=pack, bucket_windows=bucket).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out)
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_windows(rows), strict=True))
    assert all(r["kept_sha256"] == sha(r["kept"]) for r in out)


def test_op13_hashes_that_collide(spark, monkeypatch):
    real = repeated_windows.window_hashes
    monkeypatch.setattr(repeated_windows, "window_hashes", lambda h: real(h) >> repeated_windows.np.uint64(60))
    draw = random.Random(4)
    strings = {" ".join(f"w{draw.randrange(3) if draw.random() < 0.2 else 0}" for _ in range(n)).encode() for n in [draw.randint(35, 60) for _ in range(60)]}
    strings = sorted(strings)
    windows = repeated_windows.np.array([len(s.split()) - 34 for s in strings])
    times = Counter(tuple(s.split()[j : j + 35]) for s in strings for j in range(len(s.split()) - 34))
    want = [times[tuple(s.split()[j : j + 35])] > 1 for s in strings for j in range(len(s.split()) - 34)]
    assert repeated_windows.repeated_in(strings, windows, repeated_windows.np.zeros(len(strings), bool)).tolist() == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert [f(docs).count() for f in (fim.fill_in_middle, periodic_runs.periodic_runs, repeated_windows.drop_repeated_windows)] == [0, 0, 0]

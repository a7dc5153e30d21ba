"""The scores of op8, and the scores and the draw of op10, against plain Python; nothing is sampled where labels are few."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import ngram_lm, quality_rules, resample


@pytest.fixture(scope="module")
def sample(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = ngram_lm.labelled_sample(labels, (F.col("quality") == 1) & (F.col("toxic") == 0)).collect()
    return {r["__id"]: (r["__good"], r["__fold"]) for r in rows}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def models(texts, sample, grams):
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        g = grams(t)
        raw.update(g)
        if sample.get(i) == (True, 0):
            target.update(g)
    return raw, target


@pytest.mark.parametrize("least", [ngram_lm.LEAST, (0, 0)])
def test_op8_score(spark, sf, texts, sample, least):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)

    def grams(t):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(t)]
        two = [signed(long(w, long(v, 42))) % ngram_lm.PAIR_BUCKETS + ngram_lm.WORD_BUCKETS for v, w in zip(h, h[1:], strict=False)]
        return [x % ngram_lm.WORD_BUCKETS for x in h] + two

    raw, target = models(texts, sample, grams)
    kind = lambda b: int(b >= ngram_lm.WORD_BUCKETS)
    totals = [tuple(sum(n for x, n in c.items() if kind(x) == k) for c in (raw, target)) for k in (0, 1)]
    table = {}
    for b in raw:
        k = kind(b)
        r = math.log((target[b] + ngram_lm.PRIORS[k]) / (raw[b] * totals[k][1] / totals[k][0] + ngram_lm.PRIORS[k]))
        table[b] = round(r * 1e6) if abs(r) >= least[k] else 0
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r["quality"] for r in quality_rules.quality_rules(docs, labels, least=least).collect()}
    for i, t in texts.items():
        n = len(words(t))
        want = math.floor(sum(table[b] for b in grams(t)) / n) if n else None
        assert (got[i]["score"] is None) == (want is None) and (want is None or abs(got[i]["score"] - want) <= 1), i
        assert got[i]["kept"] == (not got[i]["base_failed"] and (got[i]["score"] is None or got[i]["score"] >= got[i]["cut"])), i


@pytest.mark.parametrize(("least", "per_word", "temperature", "k"), [(resample.LEAST, True, None, None), ((0, 0), False, 1.0, 60)])
def test_op10_scores_and_draw(spark, sf, texts, sample, least, per_word, temperature, k):
    h = resample.hasher()
    grams = lambda t: np.concatenate(resample.slots_of(h(t))).tolist()
    raw, target = models(texts, sample, grams)
    totals = [[sum(n for x, n in c.items() if (x >= resample.SLOTS) == kind) for c in (raw, target)] for kind in (False, True)]

    def of(b):
        kind = int(b >= resample.SLOTS)
        r = math.log((target[b] + resample.PRIORS[kind]) / (raw[b] * totals[kind][1] / totals[kind][0] + resample.PRIORS[kind]))
        return r if abs(r) >= least[kind] else 0.0

    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    out = resample.importance_resample(docs, labels, k=k, least=least, per_word=per_word, temperature=temperature)
    got = {r["doc_id"]: r["resample"] for r in out.collect()}
    for i, t in texts.items():
        n = len(words(t))
        want = sum(map(of, grams(t))) / (max(1, n) if per_word else 1)
        assert got[i]["n_words"] == n and got[i]["score"] == pytest.approx(want, abs=2e-3 + 1e-5 * abs(want)), i
        if temperature:
            assert got[i]["key"] == pytest.approx(got[i]["score"] / temperature + resample.gumbel(i, t, 0), abs=1e-9), i
    ranked = sorted(got, key=lambda i: -got[i]["key"])
    kept = [i for i in ranked if got[i]["kept"]]
    assert kept == ranked[: len(kept)] and (k is None or len(kept) == k)


def test_draw_follows_the_weights():
    """Of two documents with weights 3 to 1, the first is drawn first three times in four."""
    wins = sum(math.log(3) + resample.gumbel(i, None, 1) > resample.gumbel(i, None, 2) for i in range(4000))
    assert abs(wins / 4000 - 0.75) < 0.03

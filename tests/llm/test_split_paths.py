"""Cases of the review's first round, against brute force."""

import random

import numpy as np
import test_contract

from corpusmill.llm import ngram_join, substring_dedup


def test_op5_with_all_lists_split(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 1)
    test_contract.test_op5(spark, sf, texts)


def test_op5_links_near_copies_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words)) for i in range(90)] + [(100, " ".join([*words, "end"])), (101, " ".join(["start", *words])), (102, " ".join(f"v{i}" for i in range(120)))]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: 102 if i == 102 else 0 for i, _ in rows}


def test_op6_common_string_in_differing_surroundings_fills_no_bucket(spark, monkeypatch):
    draw, size = random.Random(5), substring_dedup.SEED
    letters = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    low = lambda x: int(substring_dedup.window_minima(x.encode() + x.encode() * 3)[0])
    common = min((letters(size) for _ in range(3000)), key=low)
    blocks = [letters(60) for _ in range(6)]
    rows = [(i, letters(60) + draw.choice(blocks)[: draw.randint(20, 60)] + common + draw.choice(blocks)[: draw.randint(20, 60)] + letters(60)) for i in range(600)]
    scan, most = substring_dedup.scan_bucket, 6000

    def bounded(bodies):
        held = sum(int((np.frombuffer(substring_dedup._unpack(b)[2], "<u4").astype(int) - 49).sum()) for _, b in bodies)
        if held > most:
            raise ValueError(f"{held} windows in a bucket")
        return scan(bodies)

    monkeypatch.setattr(substring_dedup, "scan_bucket", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, with_kept=True, pack_bytes=20_000, bucket_windows=3000).collect()}
    first: dict[str, int] = {}
    for i, t in rows:
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    assert len(got) == len(rows)
    for i, t in rows:
        gone = {p for j in range(len(t) - 49) if first[t[j : j + 50]] < i for p in range(j, j + 50)}
        assert bytes(got[i]["kept"]).decode() == "".join(c for p, c in enumerate(t) if p not in gone)
    assert any(r["n_removed"] for r in got.values())


def test_op5_with_small_groups_and_blocks(spark, sf, texts, monkeypatch):
    for name, value in (("GROUP", 2), ("BLOCK", 2), ("BITS", 1 << 10), ("HOT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    test_contract.test_op5(spark, sf, texts)


def test_op6_with_many_batches_levels_and_buckets(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_WINDOWS", 300)
    small = substring_dedup.dedup_substrings.__defaults__
    monkeypatch.setattr(substring_dedup.dedup_substrings, "__defaults__", (*small[:3], 20_000, 2_000, 30_000))
    monkeypatch.setattr(substring_dedup.scan_bucket, "__defaults__", (300,))
    monkeypatch.setattr(substring_dedup, "PART", 5_000)
    test_contract.test_op6(spark, sf, texts)

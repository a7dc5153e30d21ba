"""The queries against plain Python on a small table."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from corpusmill.llm.registry import QUERIES

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
run = lambda name, spark, sf: {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def listed(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_op1(spark, sf, texts):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    kinds, got = ["email", "ip", "card", "phone"], run("op1_pii", spark, sf)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0])]
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)], i
        assert r["base_sha256"] == sha(listed(base, kinds)), (i, listed(base, kinds), r["spans"])
        assert {x for x in listed(base, kinds).split(",") if x} <= set(r["spans"].split(","))
    assert "email:" in got[2007]["spans"] and got[2007]["spans"].count("email") == 2


def test_op2(spark, sf, texts):
    rules = [
        (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    kinds, got = ["assign", "access", "hex"], run("op2_secret_scan", spark, sf)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m)]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)], i
        assert r["base_sha256"] == sha(listed(base, kinds)), i
        assert {x for x in listed(base, kinds).split(",") if x} <= set(r["spans"].split(","))


def words3(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_op3(spark, sf, texts):
    items = {r["item_id"]: words3(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    windows = defaultdict(set)
    for k, w in items.items():
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(k))
    sizes, got, some = {len(w) for w in windows}, run("op3_decontaminate", spark, sf), 0
    for i, t in texts.items():
        w = words3(t)
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= own
        some += bool(hit)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit)), i
        assert r["items_sha256"] == sha(",".join(sorted(found)))
    assert some


@pytest.fixture(scope="session")
def ids_of():
    import public_tokenizers
    from tokenizers import Tokenizer

    def make(name):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]

    return make


def test_op4(spark, sf, texts, ids_of):
    encode, got, at = ids_of("byte_bpe_50k.json"), run("op4_token_files", spark, sf), 0
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = encode(texts[i])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        at += len(ids)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_op5(spark, sf, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids, links = sorted(sets), 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y], links = x, links + 1
    got = run("op5_ngram_join", spark, sf)
    assert links
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), top(i)) for i in ids}


def test_op6(spark, sf, texts):
    first = {}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(raw):
        for j in range(len(raw[i]) - 49):
            first.setdefault(raw[i][j : j + 50], i)
    got, some = run("op6_substring_dedup", spark, sf), 0
    assert got.keys() == texts.keys()
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        some += any(gone)
        kept, r = bytes(c for c, g in zip(b, gone, strict=True) if not g), got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)), i
    assert some


def test_op7(spark, sf, texts, ids_of):
    encode, rows = ids_of("word_bpe_49k.json"), QUERIES["op7_packing"](spark, sf).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids, at = encode(texts[i]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part))), i
            at += r["length"]
        assert at == len(ids), i
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
    assert len(sequences) <= total / 4096 * 1.05 + 2


def test_op8(spark, sf, texts):
    got = run("op8_quality_rules", spark, sf)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        times = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        rep = {p for j in range(len(w) - 4) if times[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r, failed = got[i], len(w) < 10 or 100 * len(rep) > 20 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, i
        assert not (failed and r["kept"])


def test_op9(spark, sf, texts):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    got, some = run("op9_line_dedup", spark, sf), 0
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) < i)]
        some += len(kept) < len(lines)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept))), i
    assert some


def test_op10(spark, sf, texts):
    got = run("op10_quality_classifier", spark, sf)
    assert got.keys() == texts.keys()
    assert all(r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")) for i, r in got.items())
    kept, gone = [r["key"] for r in got.values() if r["kept"]], [r["key"] for r in got.values() if not r["kept"]]
    assert not gone or min(kept) > max(gone)

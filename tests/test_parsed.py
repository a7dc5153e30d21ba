"""Parsed content as chunks, and replies of a model, in odd cases."""

import json

from pyspark.sql import functions as F

from corpusmill.functions import answers
from corpusmill.operators.multimodal import multimodal_chunks

TABLE, EQUATION, IMAGE = "array<struct<rows: array<array<string>>, header_row: int, caption: string, page: int>>", "array<struct<latex: string, inline: boolean, page: int, surrounding_text: string>>", "array<struct<uri: string, caption: string, page: int>>"


def test_blocks_of_parsed_content(spark):
    long = [["a", "a", None]] + [[str(i), "" if i % 2 else "y", " \t"] for i in range(60)]
    docs = [
        (1, [(long, 0, "t", 2), ([["x"], ["h"], ["z", "w"], None], 1, None, None)], [("q", True, 3, "  about "), (" ", False, 0, "x"), (None, None, None, None)], [("u", "cap", 0), ("u", "", 1), ("u", None, 1)]),
        (2, None, [("L" * 2001, None, None, None)], None),
        (3, [([], 0, "none", 1), None, ([["w"], ["v" * 5000]], 9, "wide", 0)], None, None),
        (4, None, None, None),
        (None, None, None, [("u", "cap", 0)]),
    ]
    texts = spark.createDataFrame([(1, 0, "c0", "fixed", "one"), (1, 1, "c1", "fixed", "two"), (4, 0, "c2", "semantic", "four")], "doc_id long, chunk_index long, chunk_id string, strategy string, content string")
    rows = multimodal_chunks(spark.createDataFrame(docs, f"doc_id long, tables {TABLE}, equations {EQUATION}, images {IMAGE}"), texts).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_index"])):
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert set(got) == {1, 2, 3, 4}
    assert all([c[0] for c in cs] == list(range(len(cs))) for cs in got.values())
    one = got[1]
    assert [c[3] for c in one[:3]] == ["one", "two", "[表格] t · 页 2 · 第 1 行\na=0 | a_2=y"]
    assert [i for i, c in enumerate(one) if " · 列: a | a_2 | col_2\n" in c[3]] == [22, 42]
    assert one[62:] == [
        (62, "1_t0062", "table_row", "[表格] 未命名表 · 第 0 行\nh=x"),
        (63, "1_t0063", "table_row", "[表格] 未命名表 · 第 2 行\nh=z | col_1=w"),
        (64, "1_eq0064", "equation", "about\n[公式·内联]\n$q$\n页 3"),
        (65, "1_img0065", "image_caption", "[图像] cap\nref=minio:img_0bfe935e"),
    ]
    assert got[2] == [(0, "2_eq0000", "equation", f"[公式]\n$${'L' * 2000} …(截断)$$")]
    (wide,) = got[3]
    assert len(wide[3]) == 4000 + len(" …(截断)") and wide[3].endswith("v …(截断)")
    assert got[4] == [(0, "c2", "semantic", "four")]


def test_no_parsed_content(spark):
    docs = spark.createDataFrame([], f"doc_id long, tables {TABLE}, equations {EQUATION}, images {IMAGE}")
    texts = spark.createDataFrame([], "doc_id long, chunk_index long, chunk_id string, strategy string, content string")
    assert multimodal_chunks(docs, texts).collect() == []


def test_replies(spark):
    whole = {"reasoning": {"density_score": 8, "redundancy_score": "9", "recency_score": True}, "decision": "discard", "confidence": 0.9}
    cases = {
        json.dumps(whole): (True, 5.0, 8.0, 9.0, "DISCARD", 0.9, "DISCARD", "R2"),
        "so:\n```\n" + json.dumps(whole) + "\n```\n```json\n{}\n```": (True, 5.0, 8.0, 9.0, "DISCARD", 0.9, "DISCARD", "R2"),
        '{"reasoning": "none", "decision": 7, "confidence": "NaN"}': (True, 5.0, 5.0, 5.0, "KEEP", 0.5, "KEEP", "R3"),
        '["a"]': (False, 5.0, 5.0, 5.0, "KEEP", 0.5, "KEEP", "R3"),
        "no reply {": (False, 5.0, 5.0, 5.0, "KEEP", 0.5, "KEEP", "R3"),
        "": (False, 5.0, 5.0, 5.0, "KEEP", 0.5, "KEEP", "R3"),
        None: (False, 5.0, 5.0, 5.0, "KEEP", 0.5, "KEEP", "R3"),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "reply string").select("reply", answers.judged(F.col("reply"), F.lit(100), F.lit(None).cast("double")).alias("j"))
    out = {r["reply"]: r["j"] for r in rows.collect()}
    for reply, want in cases.items():
        j = out[reply]
        assert (j["parsed"], j["recency"], j["density"], j["redundancy"], j["proposed"], j["confidence"], j["decision"], j["rule"]) == want, reply

"""Queries on parsed content and on a model's replies, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue as C
from .functions import answers
from .functions.text import chunk_id
from .operators import corpus
from .operators.multimodal import multimodal_chunks as chunks_of
from .sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: Tables, equations and images are made from a document's own words: tables of four words a row, of which some are blank.
TABLE, EQUATION, IMAGE = "struct<rows: array<array<string>>, header_row: int, caption: string, page: int>", "struct<latex: string, inline: boolean, page: int, surrounding_text: string>", "struct<uri: string, caption: string, page: int>"


def parsed(docs, *more):
    id, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    words = F.transform(F.split(text, r"[ \t\n]+"), lambda w: F.when(F.length(w) % 7 == 0, "").otherwise(w))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 4)), lambda i: F.slice("words", i * 4 + 1, F.lit(4)))
    small = F.array(F.array(F.lit(""), F.lit("k"), F.lit("k")), F.array(F.col("lang"), F.lit(""), F.col("source")), F.array(F.lit(""), F.lit(" "), F.lit("")), F.array(F.col("source"), F.col("lang"), F.lit("x"), F.lit("extra")))
    table = lambda rows, header, caption, page: F.struct(rows.alias("rows"), header.cast("int").alias("header_row"), caption.alias("caption"), page.cast("int").alias("page")).cast(TABLE)
    tables = F.array_compact(F.array(F.when(id % 3 == 1, table(small, F.lit(0), F.lit(""), F.lit(0))), F.when(id % 3 < 2, table(rows, id % 7 - 1, F.col("source"), id % 4))))
    equation = lambda latex, page, around: F.struct(latex.alias("latex"), (id % 2 == 0).alias("inline"), page.cast("int").alias("page"), around.alias("surrounding_text")).cast(EQUATION)
    equations = F.array(equation(F.concat(F.lit("n = "), F.col("n_chars").cast("string")), id % 3, F.left(text, F.lit(1200))), equation(F.lit("  "), F.lit(1), F.lit("lost")), equation(F.repeat(F.lit("ab"), F.lit(1500)), F.lit(0), F.lit("")))
    image = lambda uri, caption, page: F.struct(uri.alias("uri"), caption.alias("caption"), page.cast("int").alias("page")).cast(IMAGE)
    images = F.array(image(F.concat_ws("/", "source", id.cast("string")), F.col("lang"), id % 6), image(F.col("source"), F.lit(""), F.lit(2)), image(F.lit(""), F.col("source"), F.lit(0)))
    rows_of = docs.withColumn("words", words)
    return rows_of.select("doc_id", tables.alias("tables"), F.when(id % 5 == 0, equations).alias("equations"), F.when(id % 4 == 1, images).alias("images"), *more)


@query(rf"""WITH tc AS ({C.ORACLE_SQL['boundary_chunks']}), nt AS (SELECT doc_id, count(*) AS n FROM tc GROUP BY 1),
w AS (SELECT *, coalesce(text, '') AS body, list_transform(string_split_regex(coalesce(text, ''), '[ \t\n]+'), lambda x: CASE WHEN length(x) % 7 = 0 THEN '' ELSE x END) AS ws FROM documents),
tb AS (SELECT doc_id, 1 AS t, [['', 'k', 'k'], [lang, '', source], ['', ' ', ''], [source, lang, 'x', 'extra']] AS rows, 0 AS hdr, '' AS caption, 0 AS page FROM w WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 2, list_transform(range(0, (len(ws) + 3) // 4), lambda i: ws[4 * i + 1 : 4 * i + 4]), doc_id % 7 - 1, source, doc_id % 4 FROM w WHERE doc_id % 3 < 2),
hd AS (SELECT *, CASE WHEN hdr >= 0 AND hdr < len(rows) THEN hdr ELSE 0 END AS h FROM tb),
hn AS (SELECT *, list_transform(rows[h + 1], lambda x, i: CASE WHEN trim(x) = '' THEN 'col_' || (i - 1) ELSE trim(x) END) AS plain FROM hd),
nm AS (SELECT *, list_transform(plain, lambda x, i: CASE WHEN len(list_filter(plain[1 : i - 1], lambda y: y = x)) > 0 THEN x || '_' || (len(list_filter(plain[1 : i - 1], lambda y: y = x)) + 1) ELSE x END) AS names FROM hn),
r AS (SELECT doc_id, t, caption, page, h, names, len(rows) AS n_rows, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS i FROM nm),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) - 1 AS k FROM r WHERE i <> h AND len(list_filter(cells, lambda c: trim(c) <> '')) > 0),
bl AS (SELECT doc_id, 1 AS kind, t AS a, i AS b, 'table_row' AS strategy, '[表格] ' || CASE caption WHEN '' THEN '未命名表' ELSE caption END || CASE WHEN page <> 0 THEN ' · 页 ' || page ELSE '' END || ' · 第 ' || i || ' 行'
    || CASE WHEN k > 0 AND k % 20 = 0 AND n_rows > 50 THEN ' · 列: ' || array_to_string(names, ' | ') ELSE '' END || chr(10) || array_to_string(list_filter(list_transform(cells, lambda c, j: CASE WHEN trim(c) <> '' THEN coalesce(names[j], 'col_' || (j - 1)) || '=' || c END), lambda p: p IS NOT NULL), ' | ') AS content FROM k
  UNION ALL SELECT doc_id, 2, 1, 0, 'equation', CASE WHEN body <> '' THEN regexp_replace(left(body, 1000) || CASE WHEN length(body) > 1000 THEN ' …(截断)' ELSE '' END, '^\s+|\s+$', '', 'g') || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '[公式·内联]' || chr(10) || '$n = ' || n_chars || '$' ELSE '[公式]' || chr(10) || '$$n = ' || n_chars || '$$' END || CASE WHEN doc_id % 3 > 0 THEN chr(10) || '页 ' || doc_id % 3 ELSE '' END FROM w WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 2, 2, 0, 'equation', CASE WHEN doc_id % 2 = 0 THEN '[公式·内联]' || chr(10) || '$' || repeat('ab', 1000) || ' …(截断)$' ELSE '[公式]' || chr(10) || '$$' || repeat('ab', 1000) || ' …(截断)$$' END FROM w WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 3, 1, 0, 'image_caption', '[图像] ' || lang || CASE WHEN doc_id % 6 > 0 THEN chr(10) || '页 ' || doc_id % 6 ELSE '' END || chr(10) || 'ref=minio:img_' || left(sha256(source || '/' || doc_id), 8) FROM w WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 3, 2, 0, 'image_caption', '[图像] ' || source FROM w WHERE doc_id % 4 = 1),
ct AS (SELECT doc_id, strategy, CASE WHEN strategy = 'table_row' AND length(content) > 4000 THEN left(content, 4000) || ' …(截断)' ELSE content END AS content, row_number() OVER (PARTITION BY doc_id ORDER BY kind, a, b) - 1 + coalesce(n, 0) AS chunk_index FROM bl LEFT JOIN nt USING (doc_id))
SELECT doc_id, chunk_index, doc_id || '_' || CASE strategy WHEN 'table_row' THEN 't' WHEN 'equation' THEN 'eq' ELSE 'img' END || CASE WHEN chunk_index > 9999 THEN chunk_index::VARCHAR ELSE lpad(chunk_index::VARCHAR, 4, '0') END AS chunk_id, strategy, sha256(content) AS content_sha256 FROM ct
UNION ALL SELECT doc_id, chunk_index, left(md5(doc_id || '::' || chunk_index), 16), 'fixed', sha256(substr(text, start + 1, tc.n_chars)) FROM tc JOIN documents USING (doc_id)""")
def multimodal_chunks(spark, d):
    """Every document's text, tables, equations and captions as chunks in one numbering."""
    docs = corpus.with_boundary_texts(read(spark, d, "documents"), "contents")
    texts = F.transform("contents", lambda c, i: F.struct(chunk_id(F.col("doc_id"), i).alias("chunk_id"), F.lit("fixed").alias("strategy"), c.alias("content")))
    return chunks_of(parsed(docs, texts.alias("texts"))).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


#: What a document's reply has, by doc_id: a score (missing, in quotes, no number or a number), a decision and a form (fenced, plain, broken).
DENSITY = ["", '"density_score": "7.5", ', '"density_score": "dense", ', '"density_score": 3, ', '"density_score": 9.25, ', '"density_score": null, ']
NAMED = ["keep", "ARCHIVE", "Discard", "burn", "DISCARD"]
FORMS = [("", ""), ("Here it is:\n```json\n", "\n```\nDone."), ("```", "```"), (" \n", "\n "), ("[", "]"), ("{", ""), ("```json\n", "\n")]


@query(rf"""WITH rp AS (SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN doc_id % 900 END AS age, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS overlap,
  {DENSITY!r}[doc_id % 6 + 1] AS density, {NAMED!r}[doc_id % 5 + 1] AS named FROM documents),
tx AS (SELECT *, doc_id % 7 IN (0, 1, 2, 3) AS parsed, CASE WHEN doc_id % 11 = 10 THEN '{{}}' ELSE '{{"reasoning": {{' || density || '"redundancy_score": ' || doc_id % 10 || '}}, "decision": "' || named || '", "confidence": ' || (doc_id % 21) / 20.0::DOUBLE || '}}' END AS body FROM rp),
js AS (SELECT *, CASE WHEN parsed THEN body::JSON END AS j FROM tx),
f AS (SELECT doc_id, age, parsed, coalesce(try_cast(j->'reasoning'->>'density_score' AS DOUBLE), 5) AS density, coalesce(try_cast(j->'reasoning'->>'redundancy_score' AS DOUBLE), 5) AS redundancy, coalesce(try_cast(j->>'confidence' AS DOUBLE), 0.5) AS confidence,
  CASE WHEN upper(j->>'decision') IN ('KEEP', 'ARCHIVE', 'DISCARD') THEN upper(j->>'decision') ELSE 'KEEP' END AS proposed, overlap FROM js),
g AS (SELECT *, greatest(coalesce(overlap, 0), redundancy / 10) AS used FROM f),
kp AS (SELECT *, round((least(greatest(density / 10, 0.0::DOUBLE), 1.0::DOUBLE) * 0.6::DOUBLE + (1 - least(coalesce(age, 730) / 730.0::DOUBLE, 1.0::DOUBLE)) * 0.4::DOUBLE) / (least(greatest(used, 0.0::DOUBLE), 1.0::DOUBLE) + 1), 4) AS kpi FROM g),
r AS (SELECT *, CASE WHEN kpi < 0.2 AND proposed = 'DISCARD' THEN 'R1' WHEN proposed = 'DISCARD' AND confidence >= 0.8::DOUBLE THEN 'R2' WHEN kpi BETWEEN 0.3 AND 0.55 AND confidence < 0.6::DOUBLE THEN 'R3' WHEN kpi < 0.45 OR proposed = 'ARCHIVE' THEN 'R4' ELSE 'R5' END AS rule FROM kp)
SELECT doc_id, parsed, density, redundancy, proposed, confidence, kpi, CASE rule WHEN 'R1' THEN 'DISCARD' WHEN 'R2' THEN 'DISCARD' WHEN 'R3' THEN proposed WHEN 'R4' THEN 'ARCHIVE' ELSE 'KEEP' END AS decision, rule = 'R3' AS needs_review, rule FROM r""")
def judge_replies(spark, d):
    """What follows from a reply on each document, whatever its form."""
    id = F.col("doc_id")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (id % n + 1).cast("int"))
    body = F.concat(F.lit('{"reasoning": {'), of(DENSITY, 6), F.lit('"redundancy_score": '), (id % 10).cast("string"), F.lit('}, "decision": "'), of(NAMED, 5), F.lit('", "confidence": '), ((id % 21) / 20).cast("string"), F.lit("}"))
    reply = F.concat(of([a for a, _ in FORMS], 7), F.when(id % 11 == 10, "{}").otherwise(body), of([b for _, b in FORMS], 7))
    made = answers.judged(reply, F.when(id % 13 > 0, id % 900), F.when(id % 7 > 0, (id % 11) / 10))
    return read(spark, d, "documents").select("doc_id", made.alias("j")).select("doc_id", *[f"j.{c}" for c in ("parsed", "density", "redundancy", "proposed", "confidence", "kpi", "decision", "needs_review", "rule")])

"""Line dedup: lines that many documents share are dropped everywhere but in one document.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, lines over the threshold are
dropped and the rest is put together again by position. DataFrame functions only.

Scale: the first shuffle carries one partial row per hash and task (so a line in a third of all documents is one row
from each task), the second only (hash, document, position); texts move once, in the final join. A hot line skews the
second join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, documents, let, quoted, unused, whole, written


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of docs with text_col replaced, and the struct `line_dedup` (n_lines, n_dropped).

    A key of at least min_chars code points held by at least min_docs documents loses its lines except in the smallest
    id that holds it. Null or empty text is one empty line. Rows that share an id are one document; rows without an id
    count as one document that is greater than all others. An empty table gives an empty table. A column of docs named
    `line_dedup` is replaced.
    """
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    rows = docs.select(id_.alias("id"), F.xxhash64(whole(text)).alias("row"), F.posexplode(_lines(text)).alias("pos", "line"))
    keyed = rows.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), F.col("key")).alias("h2"))
    holders = keyed if min_docs == 2 else keyed.select("h1", "h2", "id").distinct()
    # Plain columns, so that the aggregate hashes instead of sorting every line.
    none = F.max(F.col("id").isNull().cast("int"))
    shared = holders.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), none.alias("none"), F.count("*").alias("n"))
    several = (F.col("keeper") != F.col("last")) | ((F.col("none") == 1) & F.col("keeper").isNotNull())
    shared = shared.where(several if min_docs == 2 else F.col("n") >= min_docs)
    shared = written(shared.select("h1", "h2", "keeper"), "shared_lines")  # its own shuffle in the join, so that hot lines are split
    lost = keyed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("id", "row").agg(F.collect_set("pos").alias("pos"))
    of, row, pos = unused(docs, "id", "row", "pos")
    lost = lost.select(F.col("id").alias(of), F.col("row").alias(row), F.col("pos").alias(pos))
    own = {c: docs[quoted(c)] for c in docs.columns}
    joined = docs.join(lost, own[id_col].eqNullSafe(lost[of]) & (F.xxhash64(whole(own[text_col])) == lost[row]), "left")
    lines = _lines(own[text_col])
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(pos)), lambda i: F.get(x, i)), "\n"))
    new = F.when(F.col(pos).isNull(), own[text_col]).otherwise(left)
    dropped = F.when(F.col(pos).isNull(), F.lit(0)).otherwise(F.size(pos))
    counts = F.struct(F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
    return joined.select(*[new.alias(c) if c == text_col else own[c] for c in docs.columns if c.lower() != "line_dedup"], counts.alias("line_dedup"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), F.sha2(whole(F.col("text")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

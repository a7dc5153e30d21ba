"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed. The ledger is a table of (blob, rule version) pairs that have been
scanned, with their findings; only pairs it lacks are scanned, once for each distinct text, and findings are joined back
to all paths and versions with that text. DataFrame functions only.

Scale: texts move once, in the shuffle that leaves one text for each unseen blob (a blob's copies in one task are merged
before it). The join back carries (path, blob) and findings, no texts; a blob that a third of all rows share skews it,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, documents, fresh_path, quoted, whole
from .spans import found, listed, n_of, ordered

# The contract's patterns. Quantifiers that cannot give back are possessive, so that no text is quadratic.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
#: Added by the scan: the first lines of private keys, and three-part web tokens.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
KINDS = ["assign", "access", "hex", "pem", "jwt"]
RULES = "2"


def secret_spans(text: Column) -> tuple[Column, Column]:
    """The base spans and all spans of a text (not null), ordered."""
    base = [
        found(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        found(text, 1, ACCESS, lambda m: F.length(m) >= 18),
        found(text, 2, HEX, lambda m: F.lit(True)),  # runs are maximal: a shorter one would be dropped anyway
    ]
    more = [found(text, 3, PEM, lambda m: F.lit(True)), found(text, 4, JWT, lambda m: F.lit(True))]
    return ordered(*base), ordered(*base, *more)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blobs: blob, text. Returns blob, base and spans (arrays of start, kind, stop; no secret is kept)."""
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    base, spans = secret_spans(F.col("text"))
    return blobs.select("blob", place(base).alias("base"), place(spans).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str, text_col: str = "text", rules: str = RULES) -> DataFrame:
    """All columns of versions, and `blob` (sha256 of the text), `secrets` (base, spans).

    ledger: the path of the ledger, which is created or added to. Null text counts as empty; repeated rows and ties are
    one blob and keep all their rows; an empty table adds nothing. Own columns named `blob` or `secrets` are replaced.
    """
    spark = versions.sparkSession
    blob, rest = F.sha2(whole(F.col(quoted(text_col))), 256).alias("blob"), columns_but(versions, "blob", "secrets")
    addressed = versions.select(*rest, blob)
    texts = versions.select(blob, whole(F.col(quoted(text_col))).alias("text"))
    try:
        seen = spark.read.parquet(ledger).where(F.col("rules") == rules).select("blob")
        texts = texts.join(seen, "blob", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    unseen = texts.groupBy("blob").agg(F.first("text").alias("text"))
    scan_blobs(unseen).select("blob", F.when(F.size("spans") > 0, F.struct("base", "spans")).alias("secrets"), F.lit(rules).alias("rules")).write.mode("append").parquet(ledger)
    # Two scans at once, or one that is run again after a failure, may each have added a blob.
    hits = spark.read.parquet(ledger).where((F.col("rules") == rules) & F.col("secrets").isNotNull()).select("blob", "secrets").dropDuplicates(["blob"])
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    out = addressed.join(hits, "blob", "left")
    return out.select(*rest, "blob", F.coalesce("secrets", F.struct(none.alias("base"), none.alias("spans"))).alias("secrets"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_versions(documents(spark, sf_dir).select("doc_id", "text"), fresh_path(spark, "ledger"))
    base = F.col("secrets.base")
    counts = [n_of(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(listed(base, KINDS), 256).alias("base_sha256"), listed(F.col("secrets.spans"), KINDS).alias("spans"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
s AS (
  SELECT doc_id, 1 AS k, 'assign' AS kind, string_split(regexp_replace(t, '((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+))', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM d
  UNION ALL SELECT doc_id, 2, 'access', string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 3, 'hex', string_split(regexp_replace(t, '([0-9a-f]{16,})', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 4, 'pem', string_split(regexp_replace(t, '(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 5, 'jwt', string_split(regexp_replace(t, '(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d),
e AS (SELECT doc_id, k, kind, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM s),
c AS (SELECT doc_id, k, kind, i, part, sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM e),
m AS (
  SELECT doc_id, k, kind, (stop - length(part))::BIGINT AS start, stop::BIGINT AS stop FROM c
  WHERE i % 2 = 0 AND CASE k WHEN 1 THEN length(regexp_extract(part, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 WHEN 2 THEN length(part) >= 18 WHEN 3 THEN length(part) >= 16 ELSE TRUE END),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 1) AS n_assign, count(*) FILTER (WHERE k = 2) AS n_access, count(*) FILTER (WHERE k = 3) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k <= 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

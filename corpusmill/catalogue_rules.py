"""Queries on scopes, trends, versions by title and category paths, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_review as V
from .operators import catalog, governance, observability, review, versions
from .sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: user, level, own department, own departments.
USERS = [("u1", 1, None, None), ("u2", 2, None, [3, 7, 11]), ("u3", 2, None, []), ("u4", 3, 5, None), ("u5", 3, None, None), ("u6", 4, 1, None), ("u7", 4, None, None), ("BUILDING", 5, None, None), ("anonymous", 5, 2, None)]


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS dept, c_mktsegment AS owner FROM customer)
SELECT 'u1' AS "user", c_custkey FROM c UNION ALL SELECT 'u2', c_custkey FROM c WHERE dept IN (3, 7, 11) UNION ALL SELECT 'u4', c_custkey FROM c WHERE dept = 5
UNION ALL SELECT 'u6', c_custkey FROM c WHERE dept IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'BUILDING', c_custkey FROM c WHERE owner = 'BUILDING'""")
def data_scopes(spark, d):
    """What each of the stated users may see, by the five scopes."""
    tree = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    rows = read(spark, d, "customer")

    def below(region: int) -> list[int]:
        return [int(r["id"][1:]) for r in governance.descendants(tree.union(spark.createDataFrame([(f"r{region}", "")], tree.schema)), f"r{region}").where("id like 'n%'").collect()]  # a department's tree

    def seen(user, level, dept, custom) -> DataFrame:
        scope = governance.data_scope(level, F.col("c_nationkey"), F.col("c_mktsegment"), user, dept, custom, below(dept) if level == governance.DEPT_AND_CHILD and dept else None)
        return rows.where(scope).select(F.lit(user).alias("user"), "c_custkey")

    return reduce(DataFrame.union, [seen(*u) for u in USERS])


TREND = "SELECT project, any_value(samples) AS samples, count(*) AS n_buckets, arg_max(avg_value, bucket) AS current, arg_min(avg_value, bucket) AS earliest, round(arg_max(avg_value, bucket) - arg_min(avg_value, bucket), 4) AS delta, round(arg_max(avg_value, bucket) - arg_min(avg_value, bucket), 4) < -5 AS trend_alert"


def hundredths(rows: DataFrame) -> DataFrame:
    """Whole hundredths, so that averages have no halves to round."""
    return rows.withColumn("value", F.round(F.col("overall") * 100 + 1e-6))


@query(f"""WITH {V.EXTRACTED}, o AS (SELECT project, round(overall * 100 + 1e-6) AS value, row_number() OVER (PARTITION BY project ORDER BY occ, id) - 1 AS i, count(*) OVER (PARTITION BY project) AS samples FROM m),
b AS (SELECT project, i // 10 AS bucket, any_value(samples) AS samples, round(avg(value), 4) AS avg_value FROM o WHERE i // 10 > (samples - 1) // 10 - 30 GROUP BY ALL) {TREND} FROM b GROUP BY project""")
def extraction_trend(spark, d):
    return observability.bucket_trend(hundredths(review.extraction_metrics(V.extracted(spark, d))), ["project"], ["at", "id"], "value", drop=5)


@query(f"WITH b AS ({V.ORACLE_SQL['page_trend']}), s AS (SELECT o_orderpriority AS project, count(*) AS samples FROM orders GROUP BY 1) {TREND} FROM b JOIN s USING (project) GROUP BY project")
def page_quality_trend(spark, d):
    return observability.bucket_trend(hundredths(review.page_scores(V.pages_of(spark, d))), ["project"], ["at", "id"], "value", drop=5)


@query(r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' v' || (p_size % 12) || '.' || (p_partkey % 3) || '.pdf' WHEN 1 THEN p_name || '_2024-0' || (p_size % 9 + 1) || '-11' WHEN 2 THEN p_name WHEN 3 THEN 'V' || p_size ELSE p_name || ' V' || p_size || ' 20240301 -' END AS title FROM part),
k AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(title, '[vV](\d+(?:\.\d+)*)', '', 'g'), '(\d{4}[-/]?\d{2}[-/]?\d{2})', '', 'g'), '[_\-\s.]+$', '')) AS base,
  CASE WHEN regexp_extract(title, '[vV](\d+(?:\.\d+)*)', 1) <> '' THEN regexp_extract(title, '[vV](\d+(?:\.\d+)*)', 1) WHEN regexp_extract(title, '(\d{4}[-/]?\d{2}[-/]?\d{2})', 1) <> '' THEN regexp_extract(title, '(\d{4}[-/]?\d{2}[-/]?\d{2})', 1) ELSE '1.0' END AS version FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY version DESC, id) AS place, count(*) OVER (PARTITION BY base) AS n FROM k WHERE base <> '')
SELECT id, base, version, place, place = 1 AS is_latest FROM p WHERE n > 1""")
def title_version_chains(spark, d):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    title = F.when(k % 5 == 0, F.concat(name, F.lit(" v"), (F.col("p_size") % 12).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit(".pdf"))).when(k % 5 == 1, F.concat(name, F.lit("_2024-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("-11")))
    title = title.when(k % 5 == 2, name).when(k % 5 == 3, F.concat(F.lit("V"), size)).otherwise(F.concat(name, F.lit(" V"), size, F.lit(" 20240301 -")))
    return versions.titled_versions(read(spark, d, "part"), title, "p_partkey")


#: place, domain, name, parent, description.
TAXONOMY = [(0, "goods", "goods", "", "ring, bolt; gear"), (1, "goods/warm", "hot goods", "goods", "hot; warm: heated"), (2, "goods/tint", "tints", "goods", "red, blue (green)"), (3, "size", "small", "", "small large ring"), (4, "size/low", "sm", "size", "")]
SYNONYMS, HINTS = {"gizmo": "tints", "widget": "gears"}, {"ECONOMY": "size/low", "PROMO": "nowhere"}


@query(f"""WITH dm AS (SELECT * FROM (VALUES {", ".join(map(str, TAXONOMY))}) t(place, id, name, parent, description)),
kw AS (SELECT word, min(o) AS o, arg_max(id, o) AS id FROM (SELECT id, word, place * 100 + at_ AS o FROM (SELECT id, place, unnest(string_split_regex(description, '[(),.;:\s]+')) AS word, generate_subscripts(string_split_regex(description, '[(),.;:\s]+'), 1) AS at_ FROM dm) WHERE length(word) >= 2) GROUP BY word),
kp AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS k FROM kw),
ps AS (SELECT p_partkey AS id, p_type AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'goods/tint' WHEN p_partkey % 7 = 1 THEN 'lost' ELSE '' END AS given, list_transform(list_filter(list_transform(CASE WHEN p_partkey % 11 = 0 THEN []::VARCHAR[] ELSE list_append(string_split(p_name, ' '), ' ') END, lambda t: trim(t)), lambda t: t <> ''), lambda t: CASE t WHEN 'gizmo' THEN 'tints' WHEN 'widget' THEN 'gears' ELSE t END) AS topics FROM part),
tp AS (SELECT id, generate_subscripts(topics, 1) AS pos, unnest(topics) AS t FROM ps),
sc AS (SELECT tp.id, pos, 10 AS score, 0 AS k, dm.id AS dom FROM tp JOIN dm ON dm.name = t
  UNION ALL SELECT tp.id, pos, 5, place, dm.id FROM tp JOIN dm ON contains(dm.name, t) OR contains(t, dm.name) WHERE t NOT IN (SELECT name FROM dm)
  UNION ALL SELECT tp.id, pos, 3, 0, kp.id FROM tp JOIN kp ON word = t WHERE t NOT IN (SELECT name FROM dm)
  UNION ALL SELECT tp.id, pos, 2, k, kp.id FROM tp JOIN kp ON length(word) >= 3 AND (contains(word, t) OR contains(t, word)) WHERE t NOT IN (SELECT name FROM dm)),
bs AS (SELECT id, dom FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos, k) AS p FROM sc) WHERE p = 1),
r AS (SELECT ps.*, CASE WHEN given IN (SELECT id FROM dm) THEN given ELSE coalesce(dom, CASE kind WHEN 'ECONOMY' THEN 'size/low' WHEN 'PROMO' THEN 'nowhere' ELSE '' END) END AS domain_id FROM ps LEFT JOIN bs ON bs.id = ps.id),
q AS (SELECT r.*, CASE WHEN u.name IS NOT NULL THEN [u.name, m.name] WHEN m.name IS NOT NULL THEN [m.name] END AS parts FROM r LEFT JOIN dm m ON m.id = r.domain_id LEFT JOIN dm u ON u.id = m.parent)
SELECT id, domain_id, CASE WHEN parts IS NOT NULL THEN array_to_string(list_concat(parts, list_filter(topics, lambda t: NOT list_contains(parts, t) AND length(t) >= 2)[1:1]), '/') WHEN len(topics) > 0 THEN array_to_string(topics[1:2], '/') ELSE '未分类' END AS path FROM q""")
def category_paths(spark, d):
    k = F.col("p_partkey")
    topics = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.split("p_name", " "), F.array(F.lit(" "))))
    given = F.when(k % 7 == 0, "goods/tint").when(k % 7 == 1, "lost").otherwise("")
    docs = read(spark, d, "part").select(k.alias("doc_id"), topics.alias("topics"), given.alias("domain_id"), F.col("p_type").alias("doc_type"))
    return catalog.category_paths(docs, spark.createDataFrame(TAXONOMY, "place int, domain_id string, name string, parent_id string, description string"), SYNONYMS, HINTS)

"""Queries on quality metrics, reviews, routes, titles, tables and choices by preference, with their DuckDB SQL.

How the subjects land on the tables: orders are extracted documents (their lines the entities), pages of a wiki and items
of the review queue; part is the list of titles, versions and typed values; documents are the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import scores as S
from .functions import text as X
from .operators import graph, observability
from .operators import governance as G
from .operators import review as V
from .sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def text_of(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


# ---- extraction and page quality


def extracted(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("entities"), F.count_if(F.col("l_returnflag") == "R").alias("sensitive"), F.round(F.avg("l_discount") * 10, 6).alias("confidence"), (F.sum("l_quantity") * 8).alias("chars"))
    o = read(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("at"), "entities", (F.col("o_orderkey") % 3).alias("relations"), "sensitive", "confidence", "chars", F.when(F.col("o_orderkey") % 17 == 0, "failed").alias("error"))


EXTRACTED = """x AS (SELECT o_orderkey AS id, o_orderpriority AS project, o_orderdate AS occ, count(*) AS entities, o_orderkey % 3 AS relations, count(*) FILTER (WHERE l_returnflag = 'R') AS sensitive, round(avg(l_discount) * 10, 6) AS confidence, sum(l_quantity) * 8 AS chars, o_orderkey % 17 = 0 AS failed
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate),
y AS (SELECT *, CASE WHEN chars > 0 THEN entities / (chars / 1000) ELSE 0 END AS den FROM x),
z AS (SELECT *, CASE WHEN den <= 0 THEN 0.0::DOUBLE WHEN den < 5 THEN den / 5 WHEN den <= 15 THEN 1 ELSE greatest(0.4::DOUBLE, 1 - (den - 15) / 5 * 0.2::DOUBLE) END AS ds, CASE WHEN entities = 0 THEN 0.0::DOUBLE WHEN relations = 0 THEN 0.5::DOUBLE WHEN relations / entities::DOUBLE >= 0.3 THEN 1 ELSE 0.5::DOUBLE + relations / entities::DOUBLE / 0.3::DOUBLE * 0.5::DOUBLE END AS rs, CASE WHEN sensitive > 0 THEN 1.0::DOUBLE WHEN chars < 500 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS ss FROM y),
m AS (SELECT *, round(den, 3) AS density, CASE WHEN failed THEN 0 ELSE round(round(ds, 4) * 0.25::DOUBLE + round(rs, 4) * 0.3::DOUBLE + round(confidence, 4) * 0.3::DOUBLE + round(ss, 4) * 0.15::DOUBLE + 1e-9, 4) END AS overall FROM z)"""


@query(f"WITH {EXTRACTED} SELECT id, density, CASE WHEN failed THEN 0 ELSE round(ds, 4) END AS density_score, CASE WHEN failed THEN 0 ELSE round(rs, 4) END AS relations_score, CASE WHEN failed THEN 0 ELSE round(ss, 4) END AS sensitive_score, overall, failed OR overall < 0.5 AS alert FROM m")
def extraction_metrics(spark, d):
    return V.extraction_metrics(extracted(spark, d)).select("id", "density", "density_score", "relations_score", "sensitive_score", "overall", "alert")


@query(f"WITH {EXTRACTED} SELECT project, count(*) AS total, count(*) FILTER (WHERE failed OR overall < 0.5) AS alerting, round(avg(overall), 3) AS avg_overall, round(avg(entities), 2) AS avg_entities, round(avg(relations), 2) AS avg_relations, round(avg(confidence), 4) AS avg_confidence, round(avg(density), 3) AS avg_density FROM m GROUP BY 1")
def extraction_aggregate(spark, d):
    return V.extraction_aggregate(V.extraction_metrics(extracted(spark, d)), ["project"]).withColumn("avg_overall", F.round("avg_overall", 3))


@query(f"WITH {EXTRACTED} SELECT id, occ AS at, row_number() OVER (ORDER BY occ DESC, id DESC) AS place FROM m WHERE failed OR overall < 0.5 ORDER BY place LIMIT 100")
def extraction_alerts(spark, d):
    newest = V.extraction_metrics(extracted(spark, d)).where("alert").orderBy(F.desc("at"), F.desc("id")).limit(100)
    rows = newest.agg(F.sort_array(F.collect_list(F.struct("at", "id")), asc=False).alias("rows"))  # the 100 of the report
    return rows.select(F.posexplode("rows").alias("p", "x")).select("x.id", "x.at", (F.col("p") + 1).cast("long").alias("place"))


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dims = {"consistency": (k % 11) / 10, "completeness": (k % 7) / 5, "evidence": (c % 5) / 4, "repetition": (k % 3) / 2, "freshness": (c % 9) / 8 - 0.25, "cross_domain": (k % 13) / 12}
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("project"), c.alias("page"), F.col("o_orderdate").alias("at"), k.alias("id"), *[v.cast("double").alias(n) for n, v in dims.items()])


PAGES = """pg AS (SELECT o_orderpriority AS project, o_custkey AS page, o_orderdate AS occ, o_orderkey AS id, least((o_orderkey % 11) / 10.0::DOUBLE, 1.0::DOUBLE) AS consistency, least((o_orderkey % 7) / 5.0::DOUBLE, 1.0::DOUBLE) AS completeness, (o_custkey % 5) / 4.0::DOUBLE AS evidence, (o_orderkey % 3) / 2.0::DOUBLE AS repetition,
  greatest((o_custkey % 9) / 8.0::DOUBLE - 0.25, 0.0::DOUBLE) AS freshness, (o_orderkey % 13) / 12.0::DOUBLE AS cross_domain FROM orders),
ps AS (SELECT *, round(round(consistency, 4) * 0.2::DOUBLE + round(completeness, 4) * 0.2::DOUBLE + round(evidence, 4) * 0.2::DOUBLE + round(repetition, 4) * 0.1::DOUBLE + round(freshness, 4) * 0.15::DOUBLE + round(cross_domain, 4) * 0.15::DOUBLE + 1e-9, 4) AS overall FROM pg)"""


@query(f"WITH {PAGES} SELECT id, page, freshness, completeness, overall, overall < 0.6 AS alert FROM ps")
def page_scores(spark, d):
    return V.page_scores(pages_of(spark, d)).select("id", "page", "freshness", "completeness", "overall", "alert")


@query(f"WITH {PAGES}, l AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY project, page ORDER BY occ DESC, id DESC) = 1) SELECT project, count(*) AS pages, count(*) FILTER (WHERE overall < 0.6) AS alerting, " + ", ".join(f"round(avg({c}), 4) AS avg_{c}" for c in (*R.PAGE_WEIGHTS, "overall")) + " FROM l GROUP BY 1")
def page_aggregate(spark, d):
    return V.page_aggregate(V.page_scores(pages_of(spark, d)), "project", "page", ["at", "id"])


@query(f"WITH {PAGES}, p AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY occ, id) - 1) // 10 AS bucket FROM ps), a AS (SELECT project, bucket, count(*) AS n, round(avg(round(overall * 100 + 1e-6)), 4) AS avg_value FROM p GROUP BY ALL) SELECT project, bucket, n, avg_value FROM a QUALIFY bucket > max(bucket) OVER (PARTITION BY project) - 30")
def page_trend(spark, d):
    return observability.count_buckets(V.page_scores(pages_of(spark, d)).withColumn("value", F.round(F.col("overall") * 100 + 1e-6)), ["project"], ["at", "id"], "value")


@query("SELECT p_partkey, CASE WHEN p_size * 2 < 30 THEN 90 WHEN p_size * 2 < 50 THEN 75 WHEN p_size * 2 < 70 THEN 60 ELSE 45 END AS priority FROM part")
def provenance_priority(spark, d):
    return read(spark, d, "part").select("p_partkey", R.provenance_priority(F.col("p_size") * 2).alias("priority"))


# ---- reviews


@query("WITH a AS (SELECT p_brand AS condition, count(*) AS total, count(*) FILTER (WHERE p_size < 12) AS approved, count(*) FILTER (WHERE p_size > 40) AS rejected FROM part GROUP BY ALL) SELECT condition, total, coalesce(round(approved / nullif(approved + rejected, 0)::DOUBLE, 4), 0) AS rate, CASE WHEN total < 5 THEN 'low_samples' WHEN approved + rejected = 0 THEN 'all_pending' WHEN coalesce(round(approved / nullif(approved + rejected, 0)::DOUBLE, 4), 0) < 0.3 THEN 'low_approve' WHEN coalesce(round(approved / nullif(approved + rejected, 0)::DOUBLE, 4), 0) >= 0.7 THEN 'high_approve' ELSE 'mid_approve' END AS suggestion FROM a")
def condition_suggestions(spark, d):
    a = read(spark, d, "part").groupBy(F.col("p_brand").alias("condition")).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") < 12).alias("approved"), F.count_if(F.col("p_size") > 40).alias("rejected"))
    decided = F.col("approved") + F.col("rejected")
    return a.withColumn("rate", X.safe_ratio(F.col("approved"), decided)).select("condition", "total", "rate", R.suggestion(F.col("total"), decided, F.col("rate")).alias("suggestion"))


@query("WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'plain' ELSE 'why | SME 驳回: ' || CASE WHEN p_partkey % 4 = 1 THEN '无理由' ELSE repeat(p_name || ' ', 6) END END AS text FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN '' ELSE left(trim(split_part(text, 'SME 驳回:', 2)), 80) END AS reason FROM r")
def reject_reasons(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.lit("plain")).otherwise(R.rejected(F.lit("why"), F.when(k > 1, F.repeat(text_of(F.col("p_name"), " "), 6))))
    return read(spark, d, "part").select("p_partkey", R.reject_reason(text).alias("reason"))


def queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    status = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "reviewing").otherwise("done")
    items = o.select(k.alias("id"), status.alias("status"), F.lit("SME").alias("role"), F.when(k % 3 == 1, "ann").alias("claimed_by"), F.col("o_orderdate").alias("due"), F.when(k % 2 == 0, "old").otherwise("").alias("reason"))
    action = F.when(k % 5 == 0, "claim").when(k % 5 == 1, "decide").when(k % 5 == 2, "escalate")
    return items, o.where(k % 5 < 3).select(k.alias("id"), action.alias("action"), F.lit("bob").alias("actor"), F.when(k % 5 == 1, "approved").otherwise("late").alias("note"), F.lit("DG").alias("to_role"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderkey % 5 AS a, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'reviewing' ELSE 'done' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'ann' END AS who, o_orderdate AS due, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END AS reason FROM orders)
SELECT id, CASE WHEN a = 0 AND status = 'pending' THEN 'reviewing' WHEN a = 1 AND status = 'reviewing' THEN 'approved' WHEN a = 2 THEN 'escalated' ELSE status END AS status, CASE WHEN a = 2 THEN 'DG' ELSE 'SME' END AS role, CASE WHEN a = 0 AND status = 'pending' THEN 'bob' WHEN a <> 2 THEN who END AS claimed_by, CASE WHEN a <> 2 THEN due END AS due, CASE WHEN a = 2 THEN CASE WHEN reason = '' THEN 'late' ELSE reason || ' | late' END ELSE reason END AS reason FROM q""")
def queue_actions(spark, d):
    return V.act_on_queue(*queue(spark, d), "id")


@query("SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN 'PENDING' WHEN toxic = 1 THEN 'DISCARDED' WHEN quality = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def resolve_reviews(spark, d):
    decisions = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "DISCARD").when(F.col("quality") == 0, "ARCHIVE").otherwise("KEEP").alias("decision"))
    return V.resolve_reviews(read(spark, d, "documents").select("doc_id", F.lit("PENDING").alias("status")), decisions, "doc_id")


@query("SELECT l.doc_id, d.source, l.quality, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0 AND d.source = 'src1'")
def review_documents(spark, d):
    return read(spark, d, "labels").where("quality = 0").join(read(spark, d, "documents").where("source = 'src1'"), "doc_id").select("doc_id", "source", "quality", "n_chars")


# Who reviews (R), is asked (C) or told (I) at each workstation: workstation, place, role, part.
INVOLVED = [
    ("W1", 0, "DG", "R"), ("W1", 1, "SME", "I"), ("W1", 2, "SEC", "C"), ("W1", 3, "AIOps", "I"),
    ("W2", 0, "DG", "R"), ("W2", 1, "SME", "C"), ("W2", 2, "SEC", "C"), ("W2", 3, "AIOps", "I"),
    ("W3", 0, "DG", "R"), ("W3", 1, "SME", "I"), ("W3", 2, "SEC", "I"), ("W3", 3, "AIOps", "I"),
    ("W4", 0, "DG", "I"), ("W4", 1, "SME", "R"), ("W4", 2, "SEC", "C"), ("W4", 3, "AIOps", "I"),
    ("W5", 0, "DG", "R"), ("W5", 1, "SME", "C"), ("W5", 2, "SEC", "C"), ("W5", 3, "AIOps", "I"),
    ("W6", 0, "DG", "I"), ("W6", 1, "SME", "R"), ("W6", 2, "SEC", "C"), ("W6", 3, "AIOps", "R"),
]


@query(f"WITH m AS (SELECT * FROM (VALUES {', '.join(map(str, INVOLVED))}) t(w, i, role, part)), r AS (SELECT w AS workstation, arg_min(role, i) FILTER (WHERE part = 'R') AS primary_role, coalesce(string_agg(role, ',' ORDER BY i) FILTER (WHERE part = 'C'), '') AS co_review FROM m GROUP BY 1) SELECT o_orderkey, workstation, primary_role, co_review FROM orders JOIN r ON workstation = 'W' || (o_orderkey % 6 + 1)")
def reviewer_roles(spark, d):
    matrix = spark.createDataFrame(INVOLVED, "workstation string, place int, role string, part string")
    roles = V.reviewers(matrix).select("workstation", F.col("primary").alias("primary_role"), F.array_join("co_review", ",").alias("co_review"))
    return read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("W"), (F.col("o_orderkey") % 6 + 1).cast("string")).alias("workstation")).join(roles, "workstation").select("o_orderkey", "workstation", "primary_role", "co_review")


@query("SELECT p_partkey, floor((1 - p_size / 50.0::DOUBLE) * 100)::BIGINT + CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 0 END AS priority FROM part WHERE p_size <> 50")
def review_priority(spark, d):
    return read(spark, d, "part").where("p_size <> 50").select("p_partkey", G.review_priority(F.col("p_size") / F.lit(50.0), F.col("p_partkey") % 2 == 0).alias("priority"))


@query("SELECT o_orderpriority AS project, least(floor(round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 4) * 100), 100)::BIGINT AS coverage, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def governance_health(spark, d):
    n, of = F.count("*"), lambda s: F.count_if(F.col("o_orderstatus") == s)
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("project")).agg(G.coverage(n, of("F")).alias("coverage"), of("P").alias("pending"))


@query("WITH a AS (SELECT user_id % 10 AS project, count(*) FILTER (WHERE event_type = 'error' AND value > 400) AS alerting, count(*) FILTER (WHERE event_type = 'signup') AS active FROM events GROUP BY 1) SELECT project, alerting, active, CASE WHEN alerting > 0 THEN 60 WHEN active > 0 THEN 300 ELSE 1800 END AS seconds FROM a")
def next_checks(spark, d):
    kind = F.col("event_type")
    a = read(spark, d, "events").groupBy((F.col("user_id") % 10).alias("project")).agg(F.count_if((kind == "error") & (F.col("value") > 400)).alias("alerting"), F.count_if(kind == "signup").alias("active"))
    return a.withColumn("seconds", R.next_check(F.col("alerting"), F.col("active")))


# ---- versions


def two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part")
    return p.where("p_partkey % 7 <> 0 and p_size < 45"), p.where("p_partkey % 11 <> 0 and p_brand <> 'Brand#1' and p_size > 2")


VERSIONS = "o AS (SELECT p_brand FROM part WHERE p_partkey % 7 <> 0 AND p_size < 45), n AS (SELECT p_brand FROM part WHERE p_partkey % 11 <> 0 AND p_brand <> 'Brand#1' AND p_size > 2)"


@query(f"WITH {VERSIONS}, b AS (SELECT p_brand, count(*) FILTER (WHERE v = 0) AS old, count(*) FILTER (WHERE v = 1) AS new FROM (SELECT p_brand, 0 AS v FROM o UNION ALL SELECT p_brand, 1 FROM n) GROUP BY 1), t AS (SELECT sum(old)::BIGINT AS n_old, sum(new)::BIGINT AS n_new, coalesce(string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE old = 0), '') AS added, coalesce(string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE new = 0), '') AS removed, coalesce(max(old) FILTER (WHERE new = 0), 0) AS lost FROM b) SELECT n_old, n_new, added, removed, abs(n_new - n_old) / n_old::DOUBLE > 0.3 AS moved_too_far, lost / n_old::DOUBLE >= 0.1 AS key_kind_lost, NOT (abs(n_new - n_old) / n_old::DOUBLE > 0.3 OR lost / n_old::DOUBLE >= 0.1) AS safe FROM t")
def promotion_check(spark, d):
    return V.promotion_check(*two_versions(spark, d), "p_brand").withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})


@query("WITH o AS (SELECT DISTINCT p_type AS t FROM part WHERE p_size < 12), n AS (SELECT DISTINCT p_type AS t FROM part WHERE p_size > 40) SELECT t, 'union' AS part FROM (SELECT t FROM o UNION SELECT t FROM n) UNION ALL SELECT t, 'added' FROM (SELECT t FROM n EXCEPT SELECT t FROM o) UNION ALL SELECT t, 'both' FROM (SELECT t FROM n INTERSECT SELECT t FROM o)")
def type_sets(spark, d):
    p = read(spark, d, "part")
    o, n = (p.where(w).select(F.col("p_type").alias("t")).distinct() for w in ("p_size < 12", "p_size > 40"))
    named = lambda df, name: df.select("t", F.lit(name).alias("part"))
    return named(o.union(n).distinct(), "union").union(named(n.subtract(o), "added")).union(named(n.intersect(o), "both"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'draft' || p_size || '-next' ELSE 'ont-v1.' || p_size || '.' || (p_partkey % 40 + 1) END AS version FROM part")
def version_bump(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    return read(spark, d, "part").select("p_partkey", R.next_patch(F.when(k % 5 == 0, text_of("draft", size)).otherwise(text_of("ont-v1.", size, ".", (k % 40).cast("string")))).alias("version"))


@query("SELECT p_brand AS condition, p_partkey AS version, CASE WHEN p_partkey % 3 = 0 THEN 'zh' ELSE 'en' END AS language FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, p_partkey DESC) = 1")
def active_prompt(spark, d):
    rows = read(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("condition"), F.col("p_partkey").alias("version"), F.when(F.col("p_partkey") % 3 == 0, "zh").otherwise("en").alias("language"))
    return V.preferred(rows, "condition", (F.col("language") == "zh").cast("int"), F.desc("version"))


@query("WITH v AS (SELECT p_brand AS condition, p_size AS version, count(*) AS n, round(count(*) FILTER (WHERE p_retailprice > 1000) / count(*)::DOUBLE, 4) AS rate FROM part GROUP BY ALL) SELECT condition, version, rate FROM v WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY condition ORDER BY rate DESC, version DESC) = 1")
def best_prompt(spark, d):
    v = read(spark, d, "part").groupBy(F.col("p_brand").alias("condition"), F.col("p_size").alias("version")).agg(F.count("*").alias("n"), X.safe_ratio(F.count_if(F.col("p_retailprice") > 1000), F.count("*")).alias("rate"))
    return v.where("n >= 2").groupBy("condition").agg(F.max(F.struct("rate", "version")).alias("b")).select("condition", "b.version", "b.rate")


# ---- titles and typed values

TITLE = "CASE WHEN p_partkey % 2 = 0 THEN p_name || ' v' || p_size || '.2 (2024-01-15) ' || p_brand || '.DOCX' ELSE '[' || p_name || '] Guide 2.5_' || p_brand || '-20240115.pdf' END"


@query(rf"WITH t AS (SELECT p_partkey, {TITLE} AS t FROM part) SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[vV]\d+(\.\d+)*', '', 'g'), '\d{{4}}[-/]?\d{{2}}[-/]?\d{{2}}', '', 'g'), '(?i)\.(docx?|pdf|txt|md|xlsx?)$', '', 'g'), '[\s_\-()（）\[\]]+', '', 'g')) AS stem, regexp_replace(lower(t), '[\s_\-\(\)（）\[\]【】v\d\.]+', '', 'g') AS letters FROM t")
def title_rules(spark, d):
    p, b = F.col("p_name"), F.col("p_brand")
    title = F.when(F.col("p_partkey") % 2 == 0, text_of(p, " v", F.col("p_size").cast("string"), ".2 (2024-01-15) ", b, ".DOCX")).otherwise(text_of("[", p, "] Guide 2.5_", b, "-20240115.pdf"))
    return read(spark, d, "part").select("p_partkey", R.title_stem(title).alias("stem"), R.title_letters(title).alias("letters"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang || '/' || source WHEN 2 THEN lang || '/' || source WHEN 3 THEN lang || '/' || source ELSE '' END AS domain FROM documents")
def clean_domains(spark, d):
    k, lang, source = F.col("doc_id") % 5, F.col("lang"), F.col("source")
    raw = F.when(k == 0, text_of(" L1 [", lang, "]: note ")).when(k == 1, text_of("'L1 [", lang, "]/L2 [", lang, "/", source, "]'")).when(k == 2, text_of("L2 ", lang, "/", source, ", other")).when(k == 3, text_of("/", lang, "/", source, ": note"))
    return read(spark, d, "documents").select("doc_id", R.domain_id(raw).alias("domain"))


@query("SELECT p_partkey, 'a,' || p_brand || ',' || p_type AS words, p_brand || '|' || left(repeat(p_name, 5), 32) || '|x' AS tags FROM part")
def typed_lists(spark, d):
    raw = text_of(" a , ,", F.col("p_brand"), " ,,", F.col("p_type"))
    tags = F.array(F.col("p_brand"), F.lit(" "), F.repeat("p_name", 5), F.lit("x"), *[F.lit("")] * 4, F.lit("ninth"))
    return read(spark, d, "part").select("p_partkey", F.array_join(R.keywords(raw), ",").alias("words"), F.array_join(R.feedback_tags(tags), "|").alias("tags"))


@query("SELECT p_partkey, 'ent_' || left(sha256(p_partkey || '|' || p_name || '|' || p_type), 12) AS entity, 'p' || left(sha256('PART:' || p_name), 12) AS mapping FROM part")
def stable_ids(spark, d):
    return read(spark, d, "part").select("p_partkey", X.entity_id(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")).alias("entity"), X.mapping_id(F.lit("PART"), F.col("p_name")).alias("mapping"))


@query(r"WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '([^。！？.!?\n]+[。！？.!?\n]?)', 1), lambda x: regexp_matches(x, '[^\t\n\x0B\f\r ]')) AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, sha256(array_to_string(s, '|')) AS joined_sha256 FROM s")
def split_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", R.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("joined_sha256"))


NUMBERS = "SELECT p_partkey, p_size AS s, round(p_size * 0.9::DOUBLE, 2) AS lo, round(p_size * 1.1::DOUBLE, 2) AS hi FROM part"


@query(f"SELECT p_partkey, 'use ' || s || 'kg at ' || s || ' - ' || (s + 5) || ' °C, 7 boxes' AS exact, 'use [' || lo || '-' || hi || 'kg] at [' || s || ' - ' || (s + 5) || '°C], 7 boxes' AS interval, 'use [' || CASE WHEN s >= 100 THEN '高' ELSE '中' END || 'kg] at [' || CASE WHEN s >= 100 THEN '高' ELSE '中' END || '°C], 7 boxes' AS level FROM ({NUMBERS})")
def redact_parameters(spark, d):
    s, units = F.col("p_size").cast("string"), ["g", "kg", "°C"]
    text = text_of("use ", s, "kg at ", s, " - ", (F.col("p_size") + 5).cast("string"), " °C, 7 boxes")
    return read(spark, d, "part").select("p_partkey", *[R.redacted_parameters(text, units, p).alias(p.lower()) for p in ("EXACT", "INTERVAL", "LEVEL")])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'from [客户A002], not [客户A001]' ELSE 'nobody' END AS text FROM supplier")
def redact_clients(spark, d):
    text = F.when(F.col("s_suppkey") % 2 == 0, "from Acme Steel, not Acme").otherwise("nobody")
    return read(spark, d, "supplier").select("s_suppkey", R.redacted_names(text, ["Acme", "Acme Steel"]).alias("text"))


# ---- tables, routes, catalog


@query("""WITH r AS (SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, * FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY r) - 1 AS i FROM r WHERE c_custkey % 10 <> 0)
SELECT nation, i AS chunk_index, left('[表格] table' || nation || ' · 第 ' || r || ' 行' || CASE WHEN i > 0 AND i % 20 = 0 AND n > 50 THEN ' · 列: name | col_1 | name_2' ELSE '' END || chr(10) || 'name=' || c_name || ' | col_1=' || c_custkey || CASE WHEN c_custkey % 3 > 0 THEN ' | name_2=' || c_mktsegment ELSE '' END, 4000) AS content FROM k""")
def table_chunks(spark, d):
    from pyspark.sql import Window

    nation, blank = Window.partitionBy("c_nationkey"), F.col("c_custkey") % 10 == 0
    rows = read(spark, d, "customer").withColumns({"r": F.row_number().over(nation.orderBy("c_custkey")), "n": F.count("*").over(nation)}).withColumnRenamed("c_nationkey", "nation")
    cells = F.array(F.when(~blank, F.col("c_name")), F.when(~blank, F.col("c_custkey").cast("string")), F.when(~blank & (F.col("c_custkey") % 3 > 0), F.col("c_mktsegment")))
    return V.table_chunks(rows, "nation", "r", cells, F.array(F.lit(" name"), F.lit(""), F.lit("name")), text_of("table", F.col("nation").cast("string")), F.col("n"))


HARD, EASY = ["ing\\b", "ed\\b"], ["\\bthe\\b", "\\bder\\b"]


@query(r"WITH t AS (SELECT conv_id, turn, regexp_matches(lower(text), 'ing\b')::INT + regexp_matches(lower(text), 'ed\b')::INT AS h, regexp_matches(lower(text), '\bthe\b')::INT + regexp_matches(lower(text), '\bder\b')::INT AS e, length(text) AS n FROM conversations), c AS (SELECT *, CASE WHEN h >= 2 OR h = 1 AND (e = 0 OR n > 50) THEN 'high' WHEN e >= 1 AND h = 0 THEN 'low' ELSE 'medium' END AS level FROM t) SELECT conv_id, turn, level, CASE WHEN turn % 4 = 3 OR level = 'high' THEN 'rag' WHEN level = 'low' AND (conv_id % 10) / 10.0 >= 0.7 THEN 'wiki' ELSE 'hybrid' END AS path FROM c")
def query_routes(spark, d):
    level = R.complexity(F.col("text"), HARD, EASY)
    rows = read(spark, d, "conversations").select("conv_id", "turn", level.alias("level"))
    return rows.withColumn("path", R.route(F.col("turn") % 4 != 3, F.col("level"), (F.col("conv_id") % 10) / F.lit(10.0)))


@query("SELECT p_partkey, CASE WHEN d = 0 THEN 0 WHEN q = 0 THEN least(0.1::DOUBLE * d, 0.5::DOUBLE) WHEN s > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * s) WHEN e > 0 THEN least(0.6::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * e) ELSE 0.1 END AS score FROM (SELECT p_partkey, p_size % 3 AS s, p_size % 4 AS e, p_partkey % 5 AS q, p_partkey % 7 AS d FROM part)")
def graph_scores(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.graph_score(s % 3, s % 4, k % 5, k % 7).alias("score"))


@query("SELECT doc_id FROM documents WHERE lang || '/' || source = 'en/src1' OR starts_with(lang || '/' || source, 'en/src1/') ORDER BY doc_id DESC LIMIT 10 OFFSET 5")
def branch_page(spark, d):
    path = F.concat_ws("/", "lang", "source")
    return read(spark, d, "documents").where((path == "en/src1") | F.startswith(path, F.lit("en/src1/"))).select("doc_id").orderBy(F.desc("doc_id")).offset(5).limit(10)


@query("WITH q AS (SELECT DISTINCT source AS q_source, CASE source WHEN 'src1' THEN 'en' WHEN 'src2' THEN 'xx' ELSE 'de' END AS q_lang FROM documents), c AS (SELECT q_source, doc_id, CASE WHEN lang = q_lang AND source = q_source AND doc_id % 9 = 0 THEN 0 WHEN lang = q_lang THEN 1 ELSE 2 END AS stage FROM q JOIN documents ON TRUE), m AS (SELECT q_source, min(stage) AS stage FROM c GROUP BY 1) SELECT q_source, c.stage, count(*) AS n FROM c JOIN m USING (q_source, stage) GROUP BY ALL")
def branch_fallback(spark, d):
    docs = read(spark, d, "documents").groupBy("lang", "source").agg(F.count_if(F.col("doc_id") % 9 == 0).alias("near"), F.count("*").alias("all"))
    lang = F.when(F.col("source") == "src1", "en").when(F.col("source") == "src2", "xx").otherwise("de")
    asked = docs.select("source").distinct().select(F.col("source").alias("q_source"), lang.alias("q_lang"))
    same = F.col("lang") == F.col("q_lang")
    own = docs.join(asked, F.col("source") == F.col("q_source")).where(same).select("q_source", F.lit(0).alias("stage"), F.col("near").alias("n"))
    parent = docs.groupBy("lang").agg(F.sum("all").alias("n")).join(asked, same).select("q_source", F.lit(1).alias("stage"), "n")
    full = asked.select("q_source", F.lit(2).alias("stage"), docs.agg(F.sum("all").alias("n")).scalar().alias("n"))
    parent = parent.join(own.select("q_source", F.col("n").alias("mine")), "q_source", "left").select("q_source", "stage", (F.col("n") - F.coalesce("mine", F.lit(0))).alias("n"))
    return V.first_stage(own.union(parent).union(full).where("n > 0"), "q_source", "stage")


@query("SELECT event_id, ts AS at, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE user_id % 10 = 3 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY place LIMIT 200")
def query_events(spark, d):
    rows = read(spark, d, "events").where("user_id % 10 = 3 and event_type = 'click' and ts between timestamp '2024-01-03' and timestamp '2024-01-20'").select(F.col("ts").alias("at"), "event_id").orderBy(F.desc("at"), F.desc("event_id")).limit(200)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("at", "event_id")), asc=False).alias("rows"))  # the 200 of the report
    return listed.select(F.posexplode("rows").alias("p", "x")).select("x.event_id", "x.at", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT DISTINCT project FROM (SELECT user_id % 10 AS project FROM events UNION ALL SELECT o_custkey % 12 FROM orders UNION ALL SELECT conv_id % 15 FROM conversations)")
def known_projects(spark, d):
    parts = [read(spark, d, t).select((F.col(c) % n).alias("project")).distinct() for t, c, n in (("events", "user_id", 10), ("orders", "o_custkey", 12), ("conversations", "conv_id", 15))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("SELECT p_partkey, 'a' AS one, 'b' AS two FROM part WHERE (p_size % 10) / 10.0 >= 0.5 AND (p_partkey % 10) / 10.0 >= 0.5")
def class_conflicts(spark, d):
    return read(spark, d, "part").where("(p_size % 10) / 10.0 >= 0.5 and (p_partkey % 10) / 10.0 >= 0.5").select("p_partkey", F.lit("a").alias("one"), F.lit("b").alias("two"))


# ---- graph


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT a, b FROM e WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) AND b IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def subgraph(spark, d):
    return V.inside(part_edges(spark, d), read(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("a")), read(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("b")))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT y.a AS doc, count(*) AS n_shared FROM e x JOIN e y ON x.b = y.b AND y.a <> x.a WHERE x.a = 1 GROUP BY 1")
def shared_with_one(spark, d):
    e = part_edges(spark, d)
    return e.where("a = 1").select("b").join(e.where("a <> 1"), "b").groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("n_shared"))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT b AS node, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, node LIMIT 200")
def top_degree(spark, d):
    return part_edges(spark, d).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(200)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey % 20 = 0) SELECT b AS node, string_agg(a::VARCHAR, ',' ORDER BY a) AS neighbours FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY b ORDER BY a) <= 20) GROUP BY 1")
def neighbours(spark, d):
    from pyspark.sql import Window

    e = part_edges(spark, d).where("b % 20 = 0")
    near = e.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where("r <= 20")
    return near.groupBy(F.col("b").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x.cast("string")), ",").alias("neighbours"))


@query("WITH r AS (SELECT l_suppkey AS source, CASE WHEN l_quantity > 25 THEN 'makes' ELSE 'sells' END AS rel, l_partkey AS target FROM lineitem) SELECT source, rel, target FROM r JOIN supplier ON s_suppkey = source JOIN part ON p_partkey = target WHERE rel = 'sells' OR s_nationkey IN (1, 2, 3) AND p_brand IN ('Brand#1', 'Brand#2')")
def valid_relations(spark, d):
    line = read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.when(F.col("l_quantity") > 25, "makes").otherwise("sells").alias("rel"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"))
    nodes = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.col("s_nationkey").cast("string").alias("type")).union(read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")), F.col("p_brand")))
    allowed = spark.createDataFrame([("makes", ["1", "2", "3"], ["Brand#1", "Brand#2"]), ("sells", [], [])], "rel string, sources array<string>, targets array<string>")
    out = graph.valid_relations(line, nodes, allowed)
    return out.select(F.substring("source", 2, 20).cast("long").alias("source"), "rel", F.substring("target", 2, 20).cast("long").alias("target"))


@query("WITH n AS (SELECT DISTINCT replace(p_type, ' ', '.') || '.' || p_brand AS name FROM part), k AS (SELECT DISTINCT replace(p_type, ' ', '.') AS m FROM part WHERE p_size > 45 UNION SELECT split_part(p_type, ' ', 1) FROM part WHERE p_size = 30) SELECT name, arg_max(m, length(m)) AS module FROM n LEFT JOIN k ON starts_with(name || '.', m || '.') GROUP BY 1")
def import_targets(spark, d):
    p, kind = read(spark, d, "part"), F.replace(F.col("p_type"), F.lit(" "), F.lit("."))
    known = p.where("p_size > 45").select(kind.alias("name")).union(p.where("p_size = 30").select(F.substring_index("p_type", " ", 1)))
    return V.longest_prefix(p.select(F.concat_ws(".", kind, F.col("p_brand")).alias("name")).distinct(), known, "name")

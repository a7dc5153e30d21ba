"""Queries on parts of documents, redaction, domains by keywords, audits and secured search, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C
from .functions import scores as S
from .operators import corpus, governance, search
from .operators import documents as D
from .sources.tables import dealt, read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# ---- chunks and redaction

SECTIONS = r"""d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# top' || chr(10) || text || chr(10) || '## more' || chr(10) || repeat(text || chr(10), 3) ELSE text || chr(10) || chr(10) || coalesce(source, '') END AS text FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, text, string_split(regexp_replace(text, '(^|\n)(#{1,4}\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM d),
r AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(parts) > 1 THEN parts ELSE string_split_regex(text, '\n\n+') END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS raw FROM h),
l AS (SELECT doc_id, flatten(list_transform(raw, lambda s: CASE WHEN length(s) <= 2000 THEN [s] ELSE list_transform(string_split(list_reduce(string_split(s, chr(10)), lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) > 2000 AND string_split(a, chr(1))[-1] <> '' THEN a || chr(1) || x || chr(10) ELSE a || x || chr(10) END, ''), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) END)) AS s FROM r),
p AS (SELECT doc_id, unnest(range(len(s))) AS section, unnest(s) AS content FROM l)"""


def headed(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# top\n"), t, F.lit("\n## more\n"), F.repeat(F.concat(t, F.lit("\n")), 3))).otherwise(F.concat(t, F.lit("\n\n"), F.coalesce("source", F.lit(""))))
    return read(spark, d, "documents").select("doc_id", made.alias("text"))


@query(f"""WITH RECURSIVE {SECTIONS}, q AS (SELECT * FROM p WHERE content <> ''),
w AS (SELECT doc_id, section, content AS text, 0::BIGINT AS start, CASE WHEN 300 >= length(content) THEN 300 ELSE {C.last_mark('300', 60, 'content')} END AS until FROM q
UNION ALL SELECT doc_id, section, text, until, CASE WHEN until + 300 >= length(text) THEN until + 300 ELSE {C.last_mark('until + 300', 60)} END FROM w WHERE until < length(text)),
k AS (SELECT doc_id, section, substr(text, start + 1, until - start) AS content, row_number() OVER (PARTITION BY doc_id, section ORDER BY start) - 1 AS part FROM w WHERE regexp_matches(substr(text, start + 1, until - start), '[^\\s]')),
u AS (SELECT doc_id, section, -1 AS part, content FROM q UNION ALL SELECT doc_id, section, part, content FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_index, left(md5(doc_id || '::p' || section || CASE WHEN part < 0 THEN '' ELSE 'c' || part END), 16) AS chunk_id, CASE WHEN part >= 0 THEN left(md5(doc_id || '::p' || section), 16) END AS parent_chunk_id, part < 0 AS is_parent, sha256(content) AS content_sha256 FROM u""")
def parent_child_chunks(spark, d):
    return D.parent_child_chunks(headed(spark, d)).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


def minutes(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("陈经理记录:王主任和李总找张工,压力%1$d.5MPa,李总问北方电网要80-90 ℃吗,重%1$dkg。北方说好,王主任同意%1$d", F.col("p_size"))
    rows = dealt(read(spark, d, "part").select("p_partkey", "p_size", "p_name"), "p_partkey", rows=20_000)  # few bytes each, and much work
    return rows.select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, text).otherwise(F.col("p_name")).alias("text"))


AROUND = "'[' || round(({0}) * 0.9::DOUBLE, 2) || '-' || round(({0}) * 1.1::DOUBLE, 2)"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE '管理者E记录:管理者A和管理者B找工程师A,压力' || {AROUND.format('p_size + 0.5')} || 'MPa],管理者B问客户A002要[80-90℃]吗,重' || {AROUND.format('p_size::DOUBLE')} || 'kg]。客户A001说好,管理者A同意' || p_size END AS text FROM part""")
def redact_documents(spark, d):
    return D.redact_documents(minutes(spark, d), ["北方", "北方电网"], "p_partkey", "text")[0]


@query("SELECT p_partkey, category, n::BIGINT AS n FROM (SELECT p_partkey FROM part WHERE p_partkey % 9 > 0), (VALUES ('PERSON_NAME', 6), ('PROCESS_PARAM', 3), ('CLIENT_NAME', 2)) t(category, n)")
def redaction_summary(spark, d):
    tokens = D.redact_documents(minutes(spark, d), ["北方", "北方电网"], "p_partkey", "text")[1]
    return tokens.groupBy("p_partkey", "category").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'p' || left(sha256('PERSON_NAME:' || o), 12) AS mapping_id, o AS original FROM (VALUES ('陈经理'), ('王主任'), ('李总'), ('张工')) t(o), part WHERE p_partkey % 9 > 0")
def redaction_mappings(spark, d):
    tokens = D.redact_documents(minutes(spark, d), ["北方", "北方电网"], "p_partkey", "text")[1]
    return tokens.where("category = 'PERSON_NAME'").select("mapping_id", "original").distinct()


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN left(p_name || ' ' || repeat(p_type || '/', 12), 200) WHEN p_partkey % 3 = 1 THEN p_brand ELSE left(replace(repeat(p_name || chr(10), 20), chr(10), ' '), 200) END AS summary FROM part")
def page_summaries(spark, d):
    k, n, t = F.col("p_partkey") % 3, F.col("p_name"), F.repeat(F.concat("p_type", F.lit("/")), 12)
    page = F.when(k == 0, F.concat(F.lit("# x\n## 概述 1\n\n  "), n, F.lit("  \n"), t, F.lit("\n## 其他\nno"))).when(k == 1, F.concat(F.lit("intro\n## 核心摘要\n"), "p_brand")).otherwise(F.repeat(F.concat(n, F.lit("\n")), 20))
    lines = F.split(page, "\n")
    first = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("## 概述")) | F.startswith(x, F.lit("## 核心摘要"))), True)
    rest = F.slice(lines, F.greatest(first, F.lit(1)).cast("int") + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: F.startswith(x, F.lit("##"))), True)
    said = F.filter(F.transform(F.when(stop > 0, F.slice(rest, F.lit(1), stop.cast("int") - 1)).otherwise(rest), lambda x: F.btrim(x)), lambda x: x != "")
    return read(spark, d, "part").select("p_partkey", F.left(F.when(first > 0, F.array_join(said, " ")).otherwise(F.replace(page, F.lit("\n"), F.lit(" "))), F.lit(200)).alias("summary"))


# ---- domains by keywords

FIELDS = {"law": ["license", "warranty", "copyright", "terms"], "tech": ["system", "code", "data", "server", "file"], "life": ["people", "time", "year", "water", "home", "world", "city"], "none": ["zzqx"]}
FIELD_ROWS = ", ".join(f"('{f}', '{w}')" for f, ws in FIELDS.items() for w in ws)


@query(f"WITH w AS (SELECT * FROM (VALUES {FIELD_ROWS}) t(field, word)), h AS (SELECT field, sum((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS hits FROM documents, w WHERE text IS NOT NULL GROUP BY 1) SELECT field, hits, round(hits / sum(hits) OVER ()::DOUBLE, 4) AS share FROM h")
def field_scores(spark, d):
    return D.field_scores(read(spark, d, "documents"), F.col("text"), FIELDS)


@query(f"WITH w AS (SELECT * FROM (VALUES {FIELD_ROWS}) t(field, word)), m AS (SELECT field, word, max(contains(text, word)::INT) AS hit FROM documents, w GROUP BY ALL), f AS (SELECT field, sum(hit)::BIGINT AS matched, round(least(1.0::DOUBLE, sum(hit) / greatest(5.0::DOUBLE, 2 * sqrt(count(*)))), 4) AS confidence FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY confidence DESC, field) AS place FROM f ORDER BY place LIMIT 3")
def field_ranking(spark, d):
    return D.field_ranking(read(spark, d, "documents"), F.col("text"), FIELDS)


DOMAINS = [("law", "license", "warranty, copyright. terms of use"), ("law/privacy", "the", "data, personal, consent"), ("tech", "computer system", "software/code data"), ("tech/web", "er", "server, page"), ("life", "people", "time, year, life, other"), ("life/home", "ing th", "house")]


@query(rf"""WITH dm AS (SELECT * FROM (VALUES {', '.join(map(str, DOMAINS))}) t(domain_id, name, about)),
sg AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(text, '[，。？！、\s,.?!\n]+'), lambda s: length(s) >= 2) AS seg FROM benchmark),
tk AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(seg) AS word FROM sg UNION ALL SELECT query_id, substr(s, i, n) FROM (SELECT query_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT query_id, unnest(seg) AS s FROM sg), (VALUES (2), (3), (4)) v(n)))),
dw AS (SELECT DISTINCT domain_id, name, word FROM (SELECT domain_id, name, name AS word FROM dm UNION ALL SELECT domain_id, name, substr(name, i, n) FROM (SELECT *, unnest(range(1, length(name) - n + 2)) AS i FROM dm, (VALUES (2), (3), (4)) v(n) WHERE length(name) > 2) UNION ALL SELECT domain_id, name, unnest(list_filter(regexp_split_to_array(about, '[，。、\s,./]+'), lambda w: length(w) >= 2)) FROM dm)),
nw AS (SELECT domain_id, count(*) AS n FROM dw GROUP BY 1),
ov AS (SELECT query_id, domain_id, name, count(*) AS shared FROM tk JOIN dw USING (word) GROUP BY ALL),
sc AS (SELECT o.query_id, o.domain_id, round(0.6::DOUBLE * CASE WHEN EXISTS (SELECT 1 FROM tk t WHERE t.query_id = o.query_id AND t.word = o.name) THEN 1 WHEN EXISTS (SELECT 1 FROM tk t WHERE t.query_id = o.query_id AND contains(t.word, o.name)) THEN 0.8::DOUBLE WHEN EXISTS (SELECT 1 FROM tk t WHERE t.query_id = o.query_id AND contains(o.name, t.word)) THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE * shared / n, 6) AS score FROM ov o JOIN nw USING (domain_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(regexp_replace(domain_id, '[^/]', '', 'g')) DESC, domain_id) AS place FROM sc) WHERE place <= 5""")
def route_domains(spark, d):
    return D.route_domains(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), spark.createDataFrame(DOMAINS, "domain_id string, name string, description string"))


NODES = [("n1", "the", "and of to"), ("n2", "ing", "tion ment"), ("n3", "license", "a warranty"), ("n4", "der", "und die das ist")]


@query(f"""WITH s AS (SELECT doc_id, unnest([{', '.join(f"struct_pack(p := {' + '.join([f'2 * contains(t, {chr(39)}{n}{chr(39)})::INT'] + [f'contains(t, {chr(39)}{w}{chr(39)})::INT' for w in a.split() if len(w) > 1])}, i := {i}, node := {chr(39)}{k}{chr(39)})" for i, (k, n, a) in enumerate(NODES))}]) AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
r AS (SELECT doc_id, x.node AS node, x.p AS p, row_number() OVER (PARTITION BY doc_id ORDER BY x.p DESC, x.i) AS k FROM s)
SELECT doc_id, max(CASE WHEN k = 1 THEN CASE WHEN p >= 1 THEN node ELSE '' END END) AS primary_node, max(CASE WHEN k = 1 AND p >= 1 THEN round(least(1.0::DOUBLE, p / 6.0::DOUBLE), 4) ELSE 0 END) AS primary_confidence, max(CASE WHEN k = 2 THEN CASE WHEN p >= 2 THEN node ELSE '' END END) AS secondary_node, max(CASE WHEN k = 2 AND p >= 2 THEN round(least(1.0::DOUBLE, p / 6.0::DOUBLE), 4) ELSE 0 END) AS secondary_confidence FROM r GROUP BY 1""")
def classify_by_nodes(spark, d):
    return D.classify_by_nodes(read(spark, d, "documents"), F.coalesce("text", F.lit("")), NODES)


@query("SELECT DISTINCT path, CASE path[1:2] WHEN 'en' THEN 'English,' WHEN 'de' THEN 'Deutsch,' ELSE '' END || CASE WHEN ends_with(path, '/src1') THEN 'one' ELSE '' END AS chain FROM (SELECT lang || '/' || source AS path FROM documents) WHERE path LIKE 'en/%' OR path LIKE 'de/%'")
def name_chains(spark, d):
    paths = read(spark, d, "documents").where("lang in ('en', 'de')").select(F.concat_ws("/", "lang", "source").alias("path")).distinct()
    domains = spark.createDataFrame([("en", "English"), ("de", "Deutsch"), ("en/src1", "one"), ("de/src1", "one")], "domain_id string, name string")
    chain = F.array_join("chain", ",")
    return D.name_chains(paths, domains).select("path", F.when(F.size("chain") == 1, F.concat(chain, F.lit(","))).otherwise(chain).alias("chain"))


# ---- noise, facets, events, months


@query(C.NOISE.replace("SELECT c.conv_id, c.turn, coalesce(round(bad / n.n::DOUBLE, 4), 1) AS noise", "SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 0 THEN coalesce(round(bad / n.n::DOUBLE, 4), 1) >= 0.7 ELSE FALSE END AS noise, contains(lower(left(c.text, 500)), 'the') OR contains(lower(left(c.text, 500)), 'ich') AS on_topic"))
def noise_documents(spark, d):
    title = F.when(F.col("turn") % 2 == 0, "Group Chat 7").otherwise("Report")
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", corpus.is_noise_document(title, t).alias("noise"), corpus.mentions_any(F.lit(""), t, ["the", "ich"]).alias("on_topic"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'owner' END, CASE WHEN o_orderkey % 3 = 0 THEN 'due' END) AS missing FROM orders")
def missing_facets(spark, d):
    k = F.col("o_orderkey")
    facets = F.create_map(F.lit("owner"), F.when(k % 2 > 0, "ann"), F.lit("note"), F.lit(""), F.lit("due"), F.when(k % 3 > 0, "now").otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(corpus.missing_facets(facets, ["owner", "due"]), ",").alias("missing"))


@query("SELECT event_id, left(repeat(event_type || ' ', 40), 200) AS query_text, CASE WHEN user_id % 3 = 0 THEN event_type = 'click' ELSE user_id % 5 > 0 END AS hit, greatest(0, floor(value - 100))::BIGINT AS latency_ms, least(user_id % 90, 50)::BIGINT AS n_docs FROM events")
def query_event_rows(spark, d):
    e, u = read(spark, d, "events"), F.col("user_id")
    ids = F.slice(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.repeat(i.cast("string"), 60)), F.lit(1), (u % 90).cast("int"))
    rows = e.select("event_id", F.repeat(F.concat("event_type", F.lit(" ")), 40).alias("query_text"), (u % 5).alias("sources"), F.when(u % 3 == 0, F.col("event_type") == "click").alias("hit"), F.floor(F.col("value") - 100).alias("latency_ms"), ids.alias("doc_ids"))
    return corpus.query_events(rows).select("event_id", "query_text", "hit", F.col("latency_ms").cast("long").alias("latency_ms"), F.size("doc_ids").cast("long").alias("n_docs"))


@query("SELECT DISTINCT 'orders_y' || strftime(o_orderdate, '%Ym%m') AS name, date_trunc('month', o_orderdate)::DATE AS start, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS until FROM orders")
def month_partitions(spark, d):
    day = F.trunc(F.to_date("o_orderdate"), "month")
    months = read(spark, d, "orders").select(day.alias("start")).distinct()
    return months.select(F.concat(F.lit("orders_y"), F.date_format("start", "yyyy'm'MM")).alias("name"), "start", F.add_months("start", 1).alias("until"))


@query("SELECT (max(date_trunc('month', ts)) + to_months(m::INT))::DATE AS month FROM events, (SELECT unnest(range(-6, 3)) AS m) GROUP BY m")
def recommended_months(spark, d):
    last = read(spark, d, "events").agg(F.trunc(F.to_date(F.max("ts")), "month").alias("m"))
    return last.select(F.explode(F.transform(F.sequence(F.lit(-6), F.lit(2)), lambda k: F.add_months("m", k))).alias("month"))


# ---- audits


@query("SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 11 = 0 THEN 'bad_decision' WHEN o_orderkey % 7 = 0 THEN 'types_differ' WHEN o_orderkey % 5 = 0 THEN 'no_item' WHEN o_orderpriority = '5-LOW' THEN 'other_project' WHEN o_orderpriority = '1-URGENT' THEN 'wrong_role' WHEN o_custkey % 4 = 0 THEN 'unclaimed' WHEN o_custkey % 4 = 1 THEN 'not_claimer' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS verdict FROM orders")
def merge_verdicts(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    decisions = o.select(k.alias("decision_id"), k.alias("item"), F.lit("p").alias("project"), F.when(k % 11 == 0, "maybe").when(k % 2 == 0, "Approve").otherwise("reject").alias("decision"), F.lit("ann").alias("actor"), F.lit("t").alias("type_a"), F.when(k % 7 > 0, "t").otherwise("u").alias("type_b"))
    who = F.when(F.col("o_custkey") % 4 == 1, "bob").when(F.col("o_custkey") % 4 > 1, "ann")
    items = o.where("o_orderkey % 5 > 0").select(k.alias("item"), F.when(F.col("o_orderpriority") == "5-LOW", "q").otherwise("p").alias("project"), F.when(F.col("o_orderpriority") == "1-URGENT", "DG").otherwise("SME").alias("role"), who.alias("claimed_by"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("reviewing").alias("status"))
    return D.merge_verdicts(decisions, items)


@query("WITH p AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN [-o_orderkey, -1] ELSE [-2, o_custkey] END AS sources, o_custkey % 100 AS score, o_orderkey % 3 AS missing FROM orders), t AS (SELECT DISTINCT page FROM (SELECT page, unnest(sources) AS doc FROM p) WHERE doc IN (SELECT c_custkey FROM customer)), f AS (SELECT p.page, score, CASE WHEN sources IS NULL THEN 'no_sources' WHEN t.page IS NULL THEN 'sources_gone' WHEN score < 70 OR missing > 0 THEN 'ill_supported' END AS finding FROM p LEFT JOIN t ON t.page = p.page) SELECT page, finding, CASE finding WHEN 'no_sources' THEN 85 WHEN 'sources_gone' THEN 80 ELSE CASE WHEN score < 30 THEN 90 WHEN score < 50 THEN 75 WHEN score < 70 THEN 60 ELSE 45 END END AS priority FROM f WHERE finding IS NOT NULL")
def page_audit(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sources = F.when(k % 4 == 1, F.array(-k, F.lit(-1).cast("long"))).when(k % 4 > 1, F.array(F.lit(-2).cast("long"), c))
    pages = read(spark, d, "orders").select(k.alias("page"), sources.alias("sources"), (c % 100).alias("score"), (k % 3).alias("missing"))
    return D.page_audit(pages, read(spark, d, "customer").select(F.col("c_custkey").alias("doc")))


@query("SELECT o_orderkey AS page, date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') AS days, CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') >= 90 THEN 60 WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') >= 60 THEN 45 ELSE 30 END AS priority FROM orders WHERE date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') >= 30")
def stale_pages(spark, d):
    days = F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")).cast("long")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), days.alias("days")).where("days >= 30")
    return rows.withColumn("priority", F.when(F.col("days") >= 90, 60).when(F.col("days") >= 60, 45).otherwise(30))


@query("WITH n AS (SELECT p_brand AS project, p_name AS name FROM part), l AS (SELECT * FROM n WHERE name NOT IN (SELECT p_name FROM part WHERE p_size < 3)), g AS (SELECT project, name, count(*) AS c FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name) AS place FROM g) SELECT project, sum(c)::BIGINT AS n, string_agg(name, '|' ORDER BY name) FILTER (WHERE place <= 20) AS sample FROM r GROUP BY 1 HAVING sum(c) >= 3")
def unmatched_names(spark, d):
    p = read(spark, d, "part")
    out = D.unmatched_names(p.select(F.col("p_brand").alias("project"), F.col("p_name").alias("name")), p.where("p_size < 3").select(F.col("p_name").alias("name")), "project", least=3)
    return out.withColumn("sample", F.array_join("sample", "|"))


@query("SELECT n_nationkey + 100 AS source, r AS target, 'cross_ref' AS kind FROM (SELECT n_nationkey, unnest([100 + (n_nationkey + 1) % 25, n_nationkey + 100, 999]) AS r FROM nation) WHERE r < 125 AND r <> n_nationkey + 100 UNION ALL SELECT n_regionkey + 100, n_nationkey + 100, 'parent' FROM nation WHERE n_nationkey % 2 = 0")
def page_links(spark, d):
    k = F.col("n_nationkey")
    return D.page_links(read(spark, d, "nation").select((k + 100).alias("page"), F.array((k + 1) % 25 + 100, k + 100, F.lit(999)).alias("refs"), F.when(k % 2 == 0, F.col("n_regionkey") + 100).otherwise(-1).alias("parent")))


# ---- graph


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.first_evidence(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence")), ["doc", "line"])


EDGES = "e AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, arg_min(l_orderkey || ':' || l_linenumber, l_orderkey * 100 + l_linenumber) AS evidence, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY ALL)"


@query(f"WITH {EDGES} SELECT * FROM e")
def first_evidence(spark, d):
    return typed_edges(spark, d)


@query(f"WITH {EDGES}, k AS (SELECT p_brand AS type, count(*) AS n FROM part GROUP BY 1) SELECT (SELECT sum(n)::BIGINT FROM k) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM k) AS kinds, (SELECT round(count(*) FILTER (WHERE type NOT IN ('A', 'N')) / count(*)::DOUBLE, 4) FROM e) AS custom_ratio")
def graph_metrics(spark, d):
    out = D.graph_metrics(read(spark, d, "part").select(F.col("p_brand").alias("type")), typed_edges(spark, d), ["A", "N"])
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("kinds", kinds)


@query("WITH m AS (SELECT 'm' || p_partkey AS module FROM part), e AS (SELECT DISTINCT 'm' || l_suppkey AS source, 'm' || l_partkey AS target FROM lineitem WHERE l_suppkey <> l_partkey), i AS (SELECT target AS module, count(*) AS n FROM e WHERE target IN (SELECT module FROM m) GROUP BY 1), o AS (SELECT source AS module, count(*) AS n FROM e WHERE target IN (SELECT module FROM m) GROUP BY 1) SELECT module, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, 5 + least(20, coalesce(i.n, 0) + coalesce(o.n, 0)) AS size, coalesce(i.n, 0) = 0 AND module NOT IN ('m1', 'm2') AS is_dead FROM m LEFT JOIN i USING (module) LEFT JOIN o USING (module)")
def module_stats(spark, d):
    name = lambda c: F.concat(F.lit("m"), c)
    imports = read(spark, d, "lineitem").select(name("l_suppkey").alias("source"), name("l_partkey").alias("target"))
    return D.module_stats(read(spark, d, "part").select(name("p_partkey").alias("module")), imports, ["m1", "m2"])


# ---- search under row security, with graph scores


@query(f"""WITH {C.BM25}, {C.near_sql("vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <= 2 AND (doc_id % 4 < 2 OR doc_id % 3 = 0 OR source = 'src1'))", 30)},
h AS (SELECT n.query_id, n.id AS doc_id, n.score AS vector, coalesce(bm.score, 0.0::DOUBLE) AS keyword, lang || '/' || source AS path, CASE WHEN qe.label = de.label THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END AS graph
  FROM near n JOIN documents d ON d.doc_id = n.id JOIN embeddings de ON de.vec_id = n.id JOIN embeddings qe ON qe.vec_id = n.query_id LEFT JOIN bm ON bm.query_id = n.query_id AND bm.doc_id = n.id),
s AS (SELECT query_id, doc_id, round(0.15::DOUBLE * CASE WHEN path = 'en/src1' THEN 1.0 WHEN starts_with(path, 'en/') THEN 0.4 ELSE 0.1 END + 0.25::DOUBLE * graph + 0.25::DOUBLE * keyword + 0.35::DOUBLE * vector, 4) AS score FROM h)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def secured_search(spark, d):
    docs, e = read(spark, d, "documents"), read(spark, d, "embeddings")
    allowed = C.levelled(spark, d).where(governance.may_read(F.lit("confidential"), F.lit("src1"), F.col("level"), F.col("dept"))).select("doc_id")
    hits = search.nearest(e, C.query_vectors(spark, d), k=30, allowed=allowed.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("id", "doc_id")  # row security before the cut
    same = hits.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    one = F.lit(1)
    graph = same.select("query_id", "doc_id", S.graph_score((F.col("dl") == F.col("ql")).cast("int"), F.lit(0), one, one).alias("graph"))
    keyword = search.bm25(docs, C.query_texts(spark, d), k=None, only=hits)
    out = search.hybrid(hits, keyword, docs.select("doc_id", C.path_of().alias("path")), F.lit("en/src1"), k=5, graph=graph)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))

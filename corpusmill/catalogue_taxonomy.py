"""Queries on taxonomies under edits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import taxonomy as T
from .sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Nordics", "北区"]
LISTED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
EVENTS = f"""e AS (SELECT user_id AS taxonomy, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT *, k % 10 AS kind, {LISTED}[1 + (event_id * 7 + k) % 7] AS x, {LISTED}[1 + (event_id * 3 + k // 10) % 7] AS y FROM e),
x AS (SELECT *, replace(lower(x), ' ', '_') AS xid, replace(lower(y), ' ', '_') AS yid, CASE kind WHEN 0 THEN '新增 ' || x WHEN 1 THEN '请加入：' || y || '，谢谢' WHEN 2 THEN '删除:' || lower(x) WHEN 3 THEN '把' || x || '重命名为' || y WHEN 4 THEN '将 ' || lower(x) || ' 改为 ' || y || '；' WHEN 9 THEN '看看 ' || x END AS command FROM n)"""
PARSED = rf"""c AS (SELECT *, CASE WHEN regexp_matches(command, '{T.RENAME}') THEN 'rename' WHEN regexp_matches(command, '{T.REMOVE}') THEN 'remove' WHEN regexp_matches(command, '{T.ADD}') THEN 'add' END AS op FROM x),
p AS (SELECT *, CASE op WHEN 'rename' THEN regexp_extract(command, '{T.RENAME}', 1) WHEN 'remove' THEN regexp_extract(command, '{T.REMOVE}', 1) END AS target,
  CASE op WHEN 'rename' THEN regexp_extract(command, '{T.RENAME}', 2) WHEN 'add' THEN regexp_extract(command, '{T.ADD}', 1) END AS name FROM c)"""


def commands(spark, d):
    """The events as commands: texts of several forms, merges, splits and undo, on names of regions and others."""
    e = read(spark, d, "events").select(F.col("user_id").alias("taxonomy"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    names = F.array(*map(F.lit, NAMES))
    pick = lambda at: F.element_at(names, (1 + at % 7).cast("int"))
    e = e.select("*", (F.col("k") % 10).alias("kind"), pick(F.col("event_id") * 7 + F.col("k")).alias("x"), pick(F.col("event_id") * 3 + F.floor(F.col("k") / 10)).alias("y"))
    x, y = F.col("x"), F.col("y")
    texts = [F.concat(F.lit("新增 "), x), F.concat(F.lit("请加入："), y, F.lit("，谢谢")), F.concat(F.lit("删除:"), F.lower(x)), F.concat(F.lit("把"), x, F.lit("重命名为"), y), F.concat(F.lit("将 "), F.lower(x), F.lit(" 改为 "), y, F.lit("；"))]
    said = F.when(F.col("kind") == 9, F.concat(F.lit("看看 "), x))
    for k, text in enumerate(texts):
        said = said.when(F.col("kind") == k, text)
    return e.withColumn("command", said)


@query(rf"WITH {EVENTS}, {PARSED} SELECT event_id, coalesce(op, 'none') AS op, coalesce(target, '') AS target, coalesce(name, '') AS name FROM p WHERE command IS NOT NULL")
def taxonomy_commands(spark, d):
    """Texts read as commands."""
    c = commands(spark, d).where("command is not null").select("event_id", T.text_command(F.col("command")).alias("c"))
    return c.select("event_id", F.coalesce("c.op", F.lit("none")).alias("op"), F.array_join("c.targets", ",").alias("target"), F.array_join("c.names", ",").alias("name"))


@query(rf"""WITH RECURSIVE {EVENTS}, {PARSED},
l AS (SELECT taxonomy, row_number() OVER (PARTITION BY taxonomy ORDER BY ts, event_id) AS position, x, y, CASE kind WHEN 5 THEN 'merge' WHEN 6 THEN 'split' WHEN 7 THEN 'undo' WHEN 8 THEN 'undo' ELSE coalesce(op, 'none') END AS op, xid, yid, target, name FROM p),
r AS (SELECT r_regionkey, r_name, list({{'id': lower(n_name), 'name': n_name}} ORDER BY n_nationkey) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
b AS (SELECT list({{'id': replace(lower(r_name), ' ', '_'), 'name': r_name, 'level': 2, 'description': 'region', 'children': children}} ORDER BY r_regionkey) AS tree FROM r),
s AS (SELECT taxonomy, 0::BIGINT AS position, tree, list_filter([tree], lambda z: false) AS stack FROM (SELECT DISTINCT taxonomy FROM l), b
UNION ALL
SELECT s.taxonomy, l.position,
  CASE op WHEN 'undo' THEN CASE WHEN len(stack) > 0 THEN stack[len(stack)] ELSE tree END
  WHEN 'add' THEN CASE WHEN list_contains(list_transform(tree, lambda z: z.name), l.name) THEN tree ELSE list_append(tree, {{'id': regexp_replace(lower(l.name), '[^a-zA-Z0-9_]', '_', 'g')[:32], 'name': l.name, 'level': 2, 'description': '{T.ADDED}', 'children': tree[1].children[1:0]}}) END
  WHEN 'remove' THEN list_filter(tree, lambda z: z.name <> l.target AND z.id <> l.target)
  WHEN 'rename' THEN list_transform(tree, lambda z, i: CASE WHEN i = list_position(list_transform(tree, lambda w: w.name = l.target OR w.id = l.target), true) THEN {{'id': z.id, 'name': l.name, 'level': z.level, 'description': z.description, 'children': z.children}} ELSE z END)
  WHEN 'merge' THEN CASE WHEN len(list_filter(tree, lambda z: z.id IN (xid, yid))) < 2 THEN tree ELSE list_append(list_filter(tree, lambda z: z.id NOT IN (xid, yid)), {{'id': regexp_replace(lower(x || ' ' || y), '[^a-zA-Z0-9_]', '_', 'g')[:32], 'name': x || ' ' || y, 'level': list_filter(tree, lambda z: z.id IN (xid, yid))[1].level,
    'description': '合并自 ' || array_to_string(list_transform(list_filter(tree, lambda z: z.id IN (xid, yid)), lambda z: z.name), ' / '),
    'children': list_filter(flatten(list_transform(list_filter(tree, lambda z: z.id IN (xid, yid)), lambda z: z.children)), lambda c, i: list_position(list_transform(flatten(list_transform(list_filter(tree, lambda z: z.id IN (xid, yid)), lambda z: z.children)), lambda w: w.id), c.id) = i)}}) END
  WHEN 'split' THEN CASE WHEN len(list_filter(tree, lambda z: z.id = xid)) = 0 THEN tree ELSE list_concat(list_filter(tree, lambda z: z.id <> xid), list_transform([x || ' 1', x || ' 2'], lambda w: {{'id': regexp_replace(lower(w), '[^a-zA-Z0-9_]', '_', 'g')[:32], 'name': w, 'level': list_filter(tree, lambda z: z.id = xid)[-1].level, 'description': '由 ' || list_filter(tree, lambda z: z.id = xid)[-1].name || ' 拆分而来', 'children': tree[1].children[1:0]}})) END
  ELSE tree END,
  CASE op WHEN 'none' THEN stack WHEN 'undo' THEN list_filter(stack, lambda z, i: i < len(stack)) ELSE list_filter(list_append(stack, tree), lambda z, i: i > len(stack) + 1 - {T.SNAPSHOTS}) END
FROM s JOIN l ON l.taxonomy = s.taxonomy AND l.position = s.position + 1),
f AS (SELECT taxonomy, arg_max(tree, position) AS tree FROM s GROUP BY 1), u AS (SELECT taxonomy, generate_subscripts(tree, 1) - 1 AS place, unnest(tree) AS n FROM f)
SELECT taxonomy, place, n.id AS id, n.name AS name, n.level AS level, n.description AS description, coalesce(array_to_string(list_transform(n.children, lambda z: z.id), ','), '') AS children FROM u""")
def taxonomy_edits(spark, d):
    """Regions and their nations as every user's taxonomy, after the user's events as commands."""
    c = commands(spark, d).withColumn("c", T.text_command(F.col("command")))
    id = lambda n: F.replace(F.lower(n), F.lit(" "), F.lit("_"))
    x, y, kind = F.col("x"), F.col("y"), F.col("kind")
    op = F.when(kind == 5, "merge").when(kind == 6, "split").when(kind.isin(7, 8), "undo").otherwise(F.col("c.op"))
    targets = F.when(kind == 5, F.array(id(x), id(y))).when(kind == 6, F.array(id(x))).otherwise(F.col("c.targets"))
    names = F.when(kind == 5, F.array(F.concat_ws(" ", x, y))).when(kind == 6, F.array(F.concat(x, F.lit(" 1")), F.concat(x, F.lit(" 2")))).otherwise(F.col("c.names"))
    position = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    log = c.select("taxonomy", position.alias("position"), op.alias("op"), targets.alias("targets"), names.alias("names"), F.lit(None).cast("array<string>").alias("ids"))
    nations = read(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", F.struct(F.lower("n_name").alias("id"), F.col("n_name").alias("name")).alias("child"))
    children = nations.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "child"))).alias("c"))  # 25 nations
    node = F.struct(id(F.col("r_name")).alias("id"), F.col("r_name").alias("name"), F.lit(2).alias("level"), F.lit("region").alias("description"), F.transform("c", lambda c: c["child"]).alias("children"))
    regions = read(spark, d, "region").join(children, "r_regionkey").select(F.col("r_regionkey").alias("position"), node.alias("node"))
    base = log.select("taxonomy").distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(F.broadcast(regions), "position")  # the five regions, for each taxonomy
    out = T.edited_trees(base, log)
    return out.select("taxonomy", "place", "id", "name", "level", "description", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("children"))

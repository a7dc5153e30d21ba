"""Taxonomies under edits: commands read from text, merges, splits and undo, and the tree that a log of them leaves.

A log is dealt by taxonomy and sorted there; a task then reads it as a stream of Arrow batches and holds one tree and its
last snapshots at a time, never a whole log. Snapshots share their nodes, as nodes are never changed in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

# The forms of text commands, looked for in this order, and the snapshots that undo can go back to.
RENAME = r"(?:把|将)?\s*([^\s,，。；]+)\s*(?:重命名为|改名为|改成|改为)\s*([^\s,，。；]+)"
REMOVE = r"(?:删除|去掉|移除)[\s\:：]*([^\s,，。；]+)"
ADD = r"(?:新增|添加|加入)[\s\:：]*([^\s,，。；]+)"
SNAPSHOTS = 20
ADDED, MERGED, DIVIDED = "（用户自定义节点）", "合并自 {}", "由 {} 拆分而来"

NODE = "struct<id:string,name:string,level:int,description:string,children:array<struct<id:string,name:string>>>"
ORDER = ["position", "op", "targets", "names", "ids"]


def text_command(text: Column) -> Column:
    """A text as a struct of op (rename, remove, add; null if the text has none of the forms, or is null), targets and names.

    Blanks are those of the ASCII class. A remove or rename targets a node's name or id.
    """
    part = lambda form, i: F.array(F.regexp_extract(text, form, i))
    none = F.array().cast("array<string>")
    op = F.when(text.rlike(RENAME), "rename").when(text.rlike(REMOVE), "remove").when(text.rlike(ADD), "add")
    targets = F.when(op == "rename", part(RENAME, 1)).when(op == "remove", part(REMOVE, 1)).otherwise(none)
    names = F.when(op == "rename", part(RENAME, 2)).when(op == "add", part(ADD, 1)).otherwise(none)
    return F.struct(op.alias("op"), targets.alias("targets"), names.alias("names"))


def id_of(name: str, default: str = "") -> str:
    """The id that a name gets where none is given."""
    return re.sub("[^a-zA-Z0-9_]", "_", name.lower())[:32] or default


def made(id: str, name: str, level: int, description: str, children: list = ()) -> dict:
    return {"id": id, "name": name, "level": level, "description": description, "children": list(children)}


def edited(tree: list[dict], op: str, targets: list[str], names: list[str], ids: list[str]) -> list[dict]:
    """The tree after a command; the same list where the command finds nothing to do."""
    if op == "rename" and targets and names:
        at = next((i for i, n in enumerate(tree) if targets[0] in (n["name"], n["id"])), None)
        return tree if at is None else [*tree[:at], tree[at] | {"name": names[0]}, *tree[at + 1 :]]
    if op == "remove" and targets:
        return [n for n in tree if targets[0] not in (n["name"], n["id"])]
    if op == "add" and names and names[0] not in (n["name"] for n in tree):
        return [*tree, made(id_of(names[0], "custom"), names[0], 2, ADDED)]
    if op == "merge" and len(targets) > 1 and names:
        own, rest = [n for n in tree if n["id"] in targets], [n for n in tree if n["id"] not in targets]
        if len(own) > 1:
            children = {c["id"]: c for n in reversed(own) for c in reversed(n["children"] or [])}  # the first of an id stays
            order = dict.fromkeys(c["id"] for n in own for c in n["children"] or [])
            id = ids[0] if ids and ids[0] else id_of(names[0], "merged")
            return [*rest, made(id, names[0], own[0]["level"], MERGED.format(" / ".join(n["name"] or "" for n in own)), [children[c] for c in order])]
    if op == "split" and targets and names:
        own = [n for n in tree if n["id"] == targets[0]]
        if own:
            given = [(ids[i] if i < len(ids) and ids[i] else id_of(x), x) for i, x in enumerate(names)]
            text = DIVIDED.format(own[-1]["name"])[:200]
            return [*(n for n in tree if n["id"] != targets[0]), *(made(id[:64], x[:60], own[-1]["level"], text) for id, x in given if id)]
    return tree


def trees(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last tree of each taxonomy, of rows sorted by taxonomy, then order."""
    key, tree, stack = (), [], []

    def rows():
        found = [{"taxonomy": key[0], "place": i} | n for i, n in enumerate(tree)]
        return pa.RecordBatch.from_pylist(found, schema=out)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["taxonomy"],) != key:
                if key:
                    yield rows()
                key, tree, stack = (row["taxonomy"],), [], []
            op = row["op"]
            if op == "node":
                tree = [*tree, row["node"]]
            elif op == "undo":
                tree = stack.pop() if stack else tree
            else:
                stack = [*stack, tree][-SNAPSHOTS:]
                tree = edited(tree, op, *([x for x in row[c] or [] if x is not None] for c in ("targets", "names")), row["ids"] or [])
    if key:
        yield rows()


def edited_trees(base: DataFrame, log: DataFrame) -> DataFrame:
    """taxonomy, place (from 0), id, name, level, description, children: each taxonomy's nodes after its log.

    base: taxonomy, position, node (NODE); taxonomies without nodes there begin empty. log: taxonomy, position, op, targets,
    names, ids, all but the key and the order may be null. Both are ordered by position, equal positions by op, targets, names and ids.
    - add (names[0]): a node of level 2 at the end, unless one has that name. remove (targets[0]): all nodes of that name or
      id. rename (targets[0], names[0]): the first node of that name or id; its id stays.
    - merge (targets: ids, names[0], ids[0] if given): two or more nodes become one at the end, with the first one's level and the
      children of all, the first of an id.
    - split (targets[0]: an id, names, ids if given): the node makes way for new ones at the end, of its level, without children.
    - undo: the tree before the last command that is not undone, SNAPSHOTS of them at most. A command that finds nothing to
      do is one to undo as well; rows with another op, or none, are none.
    A null taxonomy is one as any other. Empty tables give no rows; a taxonomy that lost all nodes has none.
    """
    kind, none = base.schema["taxonomy"].dataType, F.lit(None).cast("array<string>")
    nodes = base.select("taxonomy", F.lit(0).alias("part"), F.col("position").cast("long").alias("position"), F.lit("node").alias("op"), *[none.alias(c) for c in ("targets", "names", "ids")], F.col("node").cast(NODE).alias("node"))
    own = log.where(F.col("op").isin("add", "remove", "rename", "merge", "split", "undo"))
    commands = own.select(F.col("taxonomy").cast(kind), F.lit(1).alias("part"), F.col("position").cast("long"), "op", "targets", "names", "ids", F.lit(None).cast(NODE).alias("node"))
    rows = nodes.unionByName(commands).repartition("taxonomy").sortWithinPartitions("taxonomy", "part", *ORDER)
    fields = [StructField("taxonomy", kind), StructField("place", LongType()), *rows.schema["node"].dataType.fields]
    out = to_arrow_schema(StructType(fields))
    return rows.mapInArrow(lambda batches: trees(batches, out), StructType(fields))

"""Documents in parts and in order: parent and child chunks, redaction with serial labels, domains by keywords, page and graph audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import chunk_id, let, mapping_id
from ..sources.tables import ROWS, dealt
from .corpus import window_cutter

# Surnames, titles with their roles, and units, that make a span a person or a parameter.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
ROLES = {"工": "工程师", "工程师": "工程师", "总": "管理者", "经理": "管理者", "主任": "管理者", "组长": "管理者", "师": "工程师", "博士": "研究员", "教授": "研究员", "研究员": "研究员"}
UNITS = ["MPa", "kPa", "Pa", "bar", "℃", "°C", "K", "kg/m³", "kg/m3", "g/L", "mol/L", "ppm", "ppb", "r/min", "rpm", "Hz", "kHz", "kV", "V", "kA", "A", "kW", "W", "MW", "kg", "g", "mg", "t", "m³", "m3", "L", "mL", "mm/s", "m/s", "km/h", "mm", "cm", "m", "km", "%", "‰"]


#: Documents whose chunks are passed on at once.
DOCS = 200


def longest_first(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


PERSON = rf"[{SURNAMES}][一-龥]{{0,2}}({longest_first(ROLES)})"
PARAMETER = rf"(-?\d{{1,4}}(?:,\d{{3}})*(?:\.\d+)?(?:\s*[-~～]\s*-?\d{{1,4}}(?:\.\d+)?)?)\s*({longest_first(UNITS)})"


def sections(text: Column, most: int = 2000) -> Column:
    """A text's sections: before each heading, or between blank lines if it has none; longer ones by whole lines.

    Blank sections stay in the array, as they count.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    marked = lambda t: F.split(F.regexp_replace(F.translate(F.coalesce(t, F.lit("")), "\x01", " "), r"(?m)^(#{1,4}\s)", "\x01$1"), "\x01")
    found = let(text, lambda t: let(marked(t), lambda m: F.when(F.size(m) > 1, m).otherwise(F.split(t, r"\n\n+"))))
    raw = F.filter(F.transform(found, strip), lambda s: s != "")

    def add(acc: Column, line: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(line) > most) & (acc["open"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"]).alias("done"), F.concat(F.when(full, F.lit("")).otherwise(acc["open"]), line, F.lit("\n")).alias("open"))

    def by_lines(section: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        end = lambda acc: F.concat(acc["done"], F.filter(F.array(strip(acc["open"])), lambda s: s != ""))
        return F.when(F.length(section) <= most, F.array(section)).otherwise(F.aggregate(F.split(section, "\n"), start, add, end))

    return F.flatten(F.transform(raw, by_lines))


def parent_child_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parent: int = 2000, child: int = 300) -> DataFrame:
    """id, chunk_index, chunk_id, parent_chunk_id (null for parents), is_parent, content.

    A section is a parent, followed by its children: windows without overlap that end after a sentence where they can.
    A document is cut and numbered where it is read, once, so nothing is shuffled.
    """
    windows = window_cutter(child, 0)
    kept = F.filter(F.transform(sections(F.col(text_col), parent), lambda s, i: F.struct(i.alias("section"), s.alias("content"))), lambda x: F.regexp_like(x["content"], F.lit(r"\S")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                places, numbers, rows = [], [], []
                for k in range(start, min(start + DOCS, batch.num_rows)):
                    own = []
                    for x in batch.column(1)[k].as_py() or []:
                        section, content = x["section"], x["content"]
                        pieces = (content[a:b] for a, b in windows(content))
                        own.append((section, -1, content))
                        own += [(section, part, piece) for part, piece in enumerate(p for p in pieces if p.strip())]
                    places += [k] * len(own)
                    numbers += range(len(own))
                    rows += own
                section, part, content = ([r[c] for r in rows] for c in range(3))
                columns = [batch.column(0).take(pa.array(places, pa.int64())), pa.array(numbers, pa.int64()), pa.array(section, pa.int32()), pa.array(part, pa.int64()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "chunk_index", "section", "part", "content"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    both = docs.select(F.col(id_col).alias("id"), kept.alias("kept")).mapInArrow(cut, f"id {id_type}, chunk_index long, section int, part long, content string")
    label = F.concat(F.lit("p"), F.col("section"))
    up, own = chunk_id(F.col("id"), label), chunk_id(F.col("id"), F.concat(label, F.lit("c"), F.col("part")))
    top = F.col("part") < 0
    return both.select(F.col("id").alias(id_col), "chunk_index", F.when(top, up).otherwise(own).alias("chunk_id"), F.when(~top, up).alias("parent_chunk_id"), top.alias("is_parent"), "content")


def redact_documents(docs: DataFrame, clients: list[str], id_col: str = "doc_id", text_col: str = "text", precision: str = "INTERVAL") -> tuple[DataFrame, DataFrame]:
    """Texts with clients, persons and parameters replaced, and the tokens (id, place, category, original, placeholder, mapping_id).

    Of spans that overlap the leftmost counts, clients before persons before parameters. Persons become their role and a
    letter, clients a number: a label's number counts the role's spans from the text's end to the last one of the same
    original, which all of its spans get. A null text stays null. Spans are numbered in their row, so nothing is shuffled.
    """
    person = F.lit(f"^(?:{PERSON})$")
    known = [r"\Q" + c + r"\E" for c in sorted(filter(None, clients), key=lambda c: (-len(c), c))]
    every = "|".join([*known, PERSON, PARAMETER])
    parts = F.split(F.regexp_replace(F.translate(F.col(text_col), "\x01", " "), every, "\x01$0\x01"), "\x01")
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    title, client = rf"^[{SURNAMES}][一-龥]{{0,2}}({longest_first(ROLES)})$", "客户A"
    kinds = sorted({client, *ROLES.values()})

    def span(original: Column, place: Column) -> Column:
        category = F.when(original.isin(clients), "CLIENT_NAME").when(F.regexp_like(original, person), "PERSON_NAME").otherwise("PROCESS_PARAM")
        role = lambda c: F.when(c == "CLIENT_NAME", client).when(c == "PERSON_NAME", roles[F.regexp_extract(original, title, 1)])
        return let(category, lambda c: F.struct(place.alias("place"), c.alias("category"), original.alias("original"), role(c).alias("role")))

    def tokens_of(spans: Column) -> Column:
        behind = lambda kind: F.transform(F.filter(F.reverse(spans), lambda s: s["role"] == kind), lambda s: s["original"])  # noqa: E731  a role's spans from the end

        def token(s: Column, by: Column) -> Column:
            number = F.coalesce(*[F.when(s["role"] == kind, F.array_position(by[f"k{i}"], s["original"])) for i, kind in enumerate(kinds)])
            letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
            new = F.when(s["category"] == "CLIENT_NAME", F.format_string(f"{client}%03d", number)).when(s["category"] == "PERSON_NAME", F.concat(s["role"], let(number, letter))).otherwise(blurred(s["original"], precision))
            return F.struct(s["place"].alias("place"), s["category"].alias("category"), s["original"].alias("original"), new.alias("placeholder"))

        return let(F.struct(spans.alias("all"), *[behind(kind).alias(f"k{i}") for i, kind in enumerate(kinds)]), lambda by: F.transform(by["all"], lambda s: token(s, by)))

    def both(ps: Column) -> Column:
        spans = F.filter(F.transform(ps, lambda p, i: F.when(i % 2 == 1, span(p, i))), lambda s: s.isNotNull())
        return F.struct(ps.alias("parts"), let(spans, tokens_of).alias("tokens"))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["parts"], lambda p, i: F.when(i % 2 == 1, F.get(x["tokens"], F.floor(i / 2).cast("int"))["placeholder"]).otherwise(p)), "")

    redacted = docs.select(F.col(id_col), let(let(parts, both), joined).alias(text_col))
    tokens = docs.select(F.col(id_col), F.explode(let(parts, lambda ps: both(ps)["tokens"])).alias("x")).select(id_col, "x.*")
    return redacted, tokens.withColumn("mapping_id", mapping_id(F.col("category"), F.col("original")))


def blurred(span: Column, precision: str) -> Column:
    """A parameter as it is (EXACT), as 高, 中 or 低 (LEVEL), or as an interval of 10 % about it; ranges stay."""
    if precision == "EXACT":
        return span
    value, unit = (F.regexp_extract(span, f"^(?:{PARAMETER})$", k) for k in (1, 2))
    number = F.regexp_replace(F.regexp_extract(value, r"^(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    if precision == "LEVEL":
        new = F.when(number >= 100, "高").when((number >= 1) | number.isNull(), "中").otherwise("低")
    else:
        new = F.when(F.regexp_like(value, F.lit("[-~～]")), value).otherwise(F.concat_ws("-", F.round(number * 0.9, 2).cast("string"), F.round(number * 1.1, 2).cast("string")))
    return F.concat(F.lit("["), new, unit, F.lit("]"))


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def field_scores(docs: DataFrame, text: Column, fields: dict[str, list[str]]) -> DataFrame:
    """field, hits, share: the occurrences of each field's keywords in all texts; one aggregate row, then a row a field."""
    sums = docs.agg(*[F.coalesce(F.sum(sum((occurrences(text, w) for w in words), F.lit(0))), F.lit(0)).alias(f"f{i}") for i, words in enumerate(fields.values())])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("hits")) for i, f in enumerate(fields)])).alias("x"), sum((F.col(f"f{i}") for i in range(len(fields))), F.lit(0)).alias("total"))
    return rows.select("x.field", "x.hits", F.coalesce(F.round(F.try_divide(F.col("x.hits").cast("double"), F.col("total").cast("double")), 4), F.lit(0.0)).alias("share"))


def field_ranking(docs: DataFrame, text: Column, fields: dict[str, list[str]], top: int = 3) -> DataFrame:
    """field, matched, confidence, place of the fields of which most keywords occur anywhere; few keywords don't help."""
    found = docs.agg(*[F.coalesce(F.max(F.contains(text, F.lit(w)).cast("int")), F.lit(0)).alias(f"w{i}_{k}") for i, words in enumerate(fields.values()) for k, w in enumerate(words)])
    matched = [sum((F.col(f"w{i}_{k}") for k in range(len(words))), F.lit(0)).cast("long") for i, words in enumerate(fields.values())]
    sure = lambda n, words: F.round(F.least(F.lit(1.0), n / max(5.0, 2 * len(words) ** 0.5)), 4)
    ranked = F.array_sort(F.array(*[F.struct((-sure(n, words)).alias("p"), F.lit(f).alias("field"), n.alias("matched")) for n, (f, words) in zip(matched, fields.items())]))
    return found.select(F.posexplode(F.slice(ranked, 1, top)).alias("place", "x")).select("x.field", "x.matched", (-F.col("x.p")).alias("confidence"), (F.col("place") + 1).cast("long").alias("place"))


def windows_of(word: Column, widths: tuple[int, ...] = (2, 3, 4)) -> Column:
    """All runs of the given widths of characters in a word."""
    runs = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*map(runs, widths)))


def route_domains(queries: DataFrame, domains: DataFrame, top: int = 5) -> DataFrame:
    """query_id, domain_id, score, place: the domains that share most words, or runs of 2 to 4 characters of their names.

    queries: query_id, query. domains: domain_id, name, description. Only pairs with a word in common are scored; ties go
    to the deeper path.
    """
    segments = F.filter(F.split("query", r"[，。？！、\s,.?!\n]+"), lambda s: F.length(s) >= 2)
    asked = queries.select("query_id", segments.alias("segments"))
    tokens = asked.select("query_id", F.explode(F.array_distinct(F.concat("segments", F.flatten(F.transform("segments", lambda s: windows_of(s)))))).alias("word"))
    own = F.when(F.length("name") > 2, windows_of(F.col("name"))).otherwise(F.array().cast("array<string>"))
    said = F.filter(F.split(F.coalesce("description", F.lit("")), r"[，。、\s,./]+"), lambda w: F.length(w) >= 2)
    words = domains.select("domain_id", "name", F.array_distinct(F.concat(F.array("name"), own, said)).alias("words"))
    words = words.select("domain_id", "name", F.size("words").alias("n"), F.explode("words").alias("word"))
    pairs = tokens.join(words, "word").groupBy("query_id", "domain_id", "name", "n").agg(F.count("*").alias("shared"), F.max((F.col("word") == F.col("name")).cast("int")).alias("whole"), F.max((F.contains("name", "word") & (F.length("word") >= 2)).cast("int")).alias("part"))
    pairs = pairs.join(asked, "query_id")
    hit = F.when(F.col("whole") == 1, 1.0).when(F.exists("segments", lambda s: F.contains(s, F.col("name"))), 0.8).when(F.col("part") == 1, 0.6).otherwise(0.0)
    scored = pairs.select("query_id", "domain_id", F.round(hit * 0.6 + F.col("shared") / F.col("n") * 0.4, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.length(F.regexp_replace("domain_id", "[^/]", ""))), "domain_id"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= top)


def classify_by_nodes(docs: DataFrame, text: Column, nodes: list[tuple[str, str, str]], id_col: str = "doc_id") -> DataFrame:
    """id, primary_node, primary_confidence, secondary_node, secondary_confidence by the nodes (id, name, description) in order.

    Two points for the name, one for each word of the description; six are full confidence. A second node needs two points.
    A document without a point has no node.
    """
    has = lambda w: F.contains(text, F.lit(w)).cast("int")
    score = lambda name, about: sum((has(w) for w in about.split() if len(w) >= 2), has(name) * 2 if name else F.lit(0))
    rated = F.array_sort(F.array(*[F.struct((-score(name, about)).alias("p"), F.lit(i).alias("i"), F.lit(node).alias("node")) for i, (node, name, about) in enumerate(nodes)]))
    first, second = (F.try_element_at(F.col("r"), F.lit(k)) for k in (1, 2))
    sure = lambda x, least: F.when(-x["p"] >= least, F.round(F.least(F.lit(1.0), -x["p"] / 6.0), 4)).otherwise(0.0)
    name = lambda x, least: F.when(-x["p"] >= least, x["node"]).otherwise("")
    return docs.select(id_col, rated.alias("r")).select(id_col, name(first, 1).alias("primary_node"), sure(first, 1).alias("primary_confidence"), name(second, 2).alias("secondary_node"), sure(second, 2).alias("secondary_confidence"))


def first_evidence(relations: DataFrame, order: list[str]) -> DataFrame:
    """source, target, type, evidence, n_docs: relations once each, with the first evidence; relations: also doc."""
    return relations.groupBy("source", "target", "type").agg(F.min_by("evidence", F.struct(*order)).alias("evidence"), F.count_distinct("doc").alias("n_docs"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, known: list[str]) -> DataFrame:
    """One row: nodes, edges, kinds (a map of node types to counts) and the share of edges of types not among known."""
    kinds = nodes.groupBy("type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("kinds"))
    of = edges.agg(F.count("*").alias("n_edges"), F.count_if(~F.col("type").isin(known)).alias("custom"))
    return kinds.join(of).select("n_nodes", "n_edges", "kinds", F.coalesce(F.round(F.try_divide(F.col("custom").cast("double"), F.col("n_edges").cast("double")), 4), F.lit(0.0)).alias("custom_ratio"))


def module_stats(modules: DataFrame, imports: DataFrame, entries: list[str], rows_a_task: int = ROWS) -> DataFrame:
    """module, in_degree, out_degree, size, is_dead: modules (module) by their imports (source, target), without loops and repeats.

    Dead is what nothing imports and is no entry. Imports are dealt by their number before repeats go, so that a task holds about
    rows_a_task of them; the join holds a part of the modules in memory and lets the imports pass, which are not sorted.
    """
    one = dealt(imports.where("source <> target").select("source", "target"), "source", "target", rows=rows_a_task).distinct()
    known = modules.select("module").distinct()
    one = one.join(known.withColumnRenamed("module", "target").hint("shuffle_hash"), "target", "left_semi")
    end = lambda name, i, o: F.struct(F.col(name).alias("module"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = one.select(F.explode(F.array(end("target", 1, 0), end("source", 0, 1))).alias("x")).select("x.*")
    deg = ends.groupBy("module").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = known.join(deg, "module", "left").fillna(0, ["in_degree", "out_degree"])
    dead = (F.col("in_degree") == 0) & ~F.col("module").isin(entries) & ~F.endswith("module", F.lit(".__main__"))
    return out.withColumns({"size": 5 + F.least(F.lit(20), F.col("in_degree") + F.col("out_degree")), "is_dead": dead})


def page_links(pages: DataFrame) -> DataFrame:
    """source, target, kind of links between existing pages. pages: page, refs (array), parent."""
    known = pages.select(F.col("page").alias("at")).distinct()
    refs = pages.select(F.col("page").alias("source"), F.explode("refs").alias("target"), F.lit("cross_ref").alias("kind")).where("source <> target")
    up = pages.where("parent is not null").select(F.col("parent").alias("source"), F.col("page").alias("target"), F.lit("parent").alias("kind"))
    refs = refs.join(known, F.col("target") == F.col("at"), "left_semi")
    return refs.union(up.join(known, F.col("source") == F.col("at"), "left_semi"))


def merge_verdicts(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """decision_id and verdict: `approved`, `rejected`, or the first guard that a decision on a merge fails.

    decisions: decision_id, item, project, decision, actor, type_a, type_b. queue: item, project, role, claimed_by, status.
    """
    q = queue.select("item", F.col("project").alias("q_project"), F.col("role").alias("q_role"), F.coalesce("claimed_by", F.lit("")).alias("q_who"), F.col("status").alias("q_status"), F.lit(True).alias("q_there"))
    rows = decisions.join(q, "item", "left")
    said = F.lower(F.coalesce("decision", F.lit("")))
    verdict = (
        F.when(~said.isin("approve", "reject"), "bad_decision").when(~F.col("type_a").eqNullSafe(F.col("type_b")), "types_differ").when(F.col("q_there").isNull(), "no_item")
        .when(~F.col("q_project").eqNullSafe(F.col("project")), "other_project").when(~F.col("q_role").eqNullSafe(F.lit("SME")), "wrong_role").when(F.col("q_who") == "", "unclaimed")
        .when(~F.col("q_who").eqNullSafe(F.col("actor")), "not_claimer").when(~F.coalesce(F.col("q_status").isin("pending", "reviewing", "claimed"), F.lit(False)), "closed").when(said == "approve", "approved").otherwise("rejected")
    )
    return rows.select("decision_id", verdict.alias("verdict"))


def page_audit(pages: DataFrame, raw: DataFrame, least: int = 70) -> DataFrame:
    """page, finding, priority of pages without sources (85), whose sources are all gone (80), or ill supported (by score).

    pages: page, sources (array), score, missing (number of claims without a source). raw: doc. The first six sources count.
    """
    used = pages.select("page", F.explode(F.slice("sources", 1, 6)).alias("doc"))
    there = used.join(raw.select("doc"), "doc", "left_semi").select("page").distinct().withColumn("there", F.lit(True))
    rows = pages.join(there, "page", "left")
    none = F.coalesce(F.size("sources"), F.lit(0)) < 1
    weak = (F.col("score") < least) | (F.col("missing") > 0)
    finding = F.when(none, "no_sources").when(F.col("there").isNull(), "sources_gone").when(weak, "ill_supported")
    return rows.select("page", finding.alias("finding"), F.when(none, 85).when(F.col("there").isNull(), 80).otherwise(R.provenance_priority(F.col("score"))).alias("priority")).where("finding is not null")


def unmatched_names(names: DataFrame, known: DataFrame, project: str, least: int = 50, sample: int = 20) -> DataFrame:
    """project, n, sample: names (project, name) that no known example (name) holds, where a project has enough; the first by name."""
    left = names.where("name <> ''").join(known.select("name"), "name", "left_anti").groupBy(project, "name").agg(F.count("*").alias("c"))
    first = left.withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy("name")))
    out = first.groupBy(project).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= sample, F.col("name")))).alias("sample"))
    return out.where(F.col("n") >= least)


def name_chains(paths: DataFrame, domains: DataFrame) -> DataFrame:
    """path and chain: the names of a path's prefixes that are known domains (domain_id, name), from the top."""
    parts = F.split("path", "/")
    steps = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "domain_id"))
    named = steps.join(domains.select("domain_id", "name"), "domain_id").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]).alias("chain"))
    return paths.join(named, "path", "left").select("path", F.coalesce("chain", F.array().cast("array<string>")).alias("chain"))

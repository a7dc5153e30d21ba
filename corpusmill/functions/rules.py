"""Column functions for extraction and page quality, reviews, routes, and values that people or models typed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights, optimum and alert thresholds of the scores.
EXTRACTION_WEIGHTS = {"density": 0.25, "relations": 0.30, "confidence": 0.30, "sensitive": 0.15}
PAGE_WEIGHTS = {"consistency": 0.20, "completeness": 0.20, "evidence": 0.20, "repetition": 0.10, "freshness": 0.15, "cross_domain": 0.15}
DENSITY_LOW, DENSITY_HIGH, EXTRACTION_ALERT, PAGE_ALERT = 5.0, 15.0, 0.5, 0.6
LEAST_SAMPLES, LOW_RATE, HIGH_RATE = 5, 0.3, 0.7
# What marks a question as complex or simple.
COMPLEX = ["对比", "比较", "区别", "和.*有什么不同", "分别", "同时", "多个", "所有", "具体.*数值", "精确", "参数", "多少度", "多少MPa", "浓度"]
SIMPLE = ["是什么", "什么是", "包含哪些", "有哪些", "概述", "简介", "总结", "说明", "频率", "标准", "要求", "规定", "流程", "步骤"]
# What comes before a reviewer's reason, and what counts as none.
REJECT_MARK, NO_REASON = "SME 驳回:", "无理由"


def density_score(density: Column) -> Column:
    """1 for 5 to 15 entities a thousand characters; less in proportion below, and down to 0.4 above."""
    over = F.greatest(F.lit(0.4), 1 - (density - DENSITY_HIGH) / 5 * 0.2)
    return F.when(density <= 0, 0.0).when(density < DENSITY_LOW, density / DENSITY_LOW).when(density <= DENSITY_HIGH, 1.0).otherwise(over)


def relation_score(entities: Column, relations: Column) -> Column:
    """0 without entities, 0.5 without relations, 1 from 0.3 relations an entity on."""
    return F.when(entities == 0, 0.0).when(relations == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + relations / entities / 0.3 * 0.5))


def sensitive_score(chars: Column, sensitive: Column) -> Column:
    return F.when(sensitive > 0, 1.0).when(chars < 500, 0.9).otherwise(0.8)


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum to four digits; halves go up, whatever the order of adding."""
    return F.round(reduce(lambda a, b: a + b, [F.round(scores[k], 4) * w for k, w in weights.items()]) + 1e-9, 4)


def suggestion(total: Column, decided: Column, rate: Column) -> Column:
    """What to say of a condition: too few samples, none decided, or a low, middling or high rate of approval."""
    return F.when(total < LEAST_SAMPLES, "low_samples").when(decided == 0, "all_pending").when(rate < LOW_RATE, "low_approve").when(rate >= HIGH_RATE, "high_approve").otherwise("mid_approve")


def provenance_priority(score: Column) -> Column:
    """The worse a page's sources, the sooner it is looked at."""
    return F.when(score < 30, 90).when(score < 50, 75).when(score < 70, 60).otherwise(45)


def next_check(alerting: Column, active: Column) -> Column:
    """Seconds until the next look: a minute under alert, five with something to watch, else half an hour."""
    return F.when(alerting > 0, 60).when(active > 0, 300).otherwise(1800)


def complexity(question: Column, complex_: list[str] = COMPLEX, simple: list[str] = SIMPLE) -> Column:
    """low, medium or high by how many of the patterns of either kind a question has."""
    count = lambda ps: reduce(lambda a, b: a + b, [F.lower(question).rlike(p).cast("int") for p in ps])
    hard, easy = count(complex_), count(simple)
    return F.when((hard >= 2) | ((hard == 1) & ((easy == 0) | (F.length(question) > 50))), "high").when((easy >= 1) & (hard == 0), "low").otherwise("medium")


def route(has_page: Column, level: Column, confidence: Column) -> Column:
    """Pages answer simple questions of a sure domain; hard ones, and domains without a page, need retrieval."""
    return F.when(~has_page | (level == "high"), "rag").when((level == "low") & (confidence >= 0.7), "wiki").otherwise("hybrid")


def reject_reason(reasoning: Column) -> Column:
    """What follows the mark, 80 characters at most; '' where there is none."""
    at = F.locate(REJECT_MARK, reasoning)
    rest = F.btrim(F.btrim(F.btrim(F.substring(reasoning, at + len(REJECT_MARK), F.length(reasoning))), F.lit("|")))
    return F.when((at == 0) | at.isNull() | (rest == NO_REASON), "").otherwise(F.left(rest, F.lit(80)))


def rejected(reasoning: Column, reason: Column) -> Column:
    return F.concat(reasoning, F.lit(f" | {REJECT_MARK} "), F.coalesce(reason, F.lit(NO_REASON)))


def next_patch(version: Column) -> Column:
    """ont-v1.0.0 gives ont-v1.0.1; anything else gets -next."""
    part = lambda k: F.regexp_extract(version, r"^ont-v(\d+)\.(\d+)\.(\d+)$", k)
    return F.when(part(1) == "", F.concat(version, F.lit("-next"))).otherwise(F.concat(F.lit("ont-v"), F.concat_ws(".", part(1), part(2), (part(3).cast("int") + 1).cast("string"))))


def domain_id(raw: Column) -> Column:
    """A domain path from what a model wrote: the longest of the bracketed ones, else without level, note and list."""
    text = F.btrim(F.btrim(F.coalesce(raw, F.lit(""))), F.lit("'\""))
    longest = F.aggregate(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    bare = F.regexp_replace(F.regexp_replace(text, r"^L\d+\s*", ""), r"^L\d+/", "")
    first = lambda c, mark: F.when(F.contains(c, F.lit(mark)), F.btrim(F.substring_index(c, mark, 1))).otherwise(c)
    return F.when(longest != "", longest).otherwise(F.ltrim(first(first(bare, ":"), ","), F.lit("/")))


def keywords(raw: Column) -> Column:
    """The words of a comma-separated string, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def feedback_tags(tags: Column) -> Column:
    """Of the first eight tags those that are not blank, trimmed, 32 characters at most."""
    return F.transform(F.filter(F.transform(F.slice(tags, 1, 8), lambda x: F.btrim(x)), lambda x: x != ""), lambda x: F.left(x, F.lit(32)))


# What the two title rules take out.
VERSION_PART, DATE_PART, FILE_END, TITLE_MARKS, TITLE_CLASS = r"[vV]\d+(\.\d+)*", r"\d{4}[-/]?\d{2}[-/]?\d{2}", r"(?i)\.(docx?|pdf|txt|md|xlsx?)$", r"[\s_\-()（）\[\]]+", r"[\s_\-\(\)（）\[\]【】v\d\.]+"


def title_stem(title: Column) -> Column:
    """A title without version, date, file ending and separators, lower-cased."""
    parts = (VERSION_PART, DATE_PART, FILE_END, TITLE_MARKS)
    return F.lower(reduce(lambda t, p: F.regexp_replace(t, p, ""), parts, title))


def title_letters(title: Column) -> Column:
    """The stricter rule: lower-cased, no digit, dot, separator or v anywhere."""
    return F.regexp_replace(F.lower(title), TITLE_CLASS, "")


def table_headers(cells: Column) -> Column:
    """Blank headers become col_i (from 0); one that repeats gets _2, _3 and so on."""
    named = F.transform(cells, lambda h, i: F.when(F.btrim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(F.btrim(h)))

    def numbered(all_: Column) -> Column:
        def name(h: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(all_, 1, i), lambda x: x == h))
            return F.when(before == 0, h).otherwise(F.concat(h, F.lit("_"), (before + 1).cast("string")))

        return F.transform(all_, name)

    return F.element_at(F.transform(F.array(named), numbered), 1)


def sentences(text: Column) -> Column:
    """Sentences with their ends, without blank ones."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^。！？.!?\n]+[。！？.!?\n]?)"), F.lit(1))
    return F.filter(found, lambda s: F.regexp_like(s, F.lit(r"\S")))


#: A number or a range, then one of the units; longest unit first.
def parameter_pattern(units: list[str]) -> str:
    return rf"(\d+(?:\.\d+)?(?:\s*[-~]\s*\d+(?:\.\d+)?)?)\s*({'|'.join(sorted(units, key=lambda u: (-len(u), u)))})"


def redacted_parameters(text: Column, units: list[str], precision: str = "INTERVAL") -> Column:
    """Parameters as they are (EXACT), as an interval of 10 % about them (INTERVAL; ranges stay), or as 高, 中, 低 (LEVEL)."""
    if precision == "EXACT":
        return text
    parts = F.split(F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), parameter_pattern(units), "\x01$1\x02$2\x01"), "\x01")

    def shown(part: Column, i: Column) -> Column:
        value, unit = F.substring_index(part, "\x02", 1), F.substring_index(part, "\x02", -1)
        number = F.regexp_extract(value, r"^(\d+(?:\.\d+)?)", 1).cast("double")
        if precision == "LEVEL":
            new = F.when(number >= 100, "高").when(number >= 1, "中").otherwise("低")
        else:
            around = F.concat_ws("-", F.round(number * 0.9, 2).cast("string"), F.round(number * 1.1, 2).cast("string"))
            new = F.when(F.regexp_like(value, F.lit("[-~]")), value).otherwise(around)
        return F.when(i % 2 == 1, F.concat(F.lit("["), new, unit, F.lit("]"))).otherwise(part)

    return F.array_join(F.transform(parts, shown), "")


def redacted_names(text: Column, names: list[str], label: str = "客户A") -> Column:
    """Known names, longest first, become the label with a number of three digits by the name's place in the list."""
    order = sorted(range(len(names)), key=lambda k: -len(names[k]))
    return reduce(lambda t, k: F.replace(t, F.lit(names[k]), F.lit(f"[{label}{k + 1:03d}]")), order, text)

"""Column functions over text: ids and hashes, tokens, titles, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(doc: Column, index: Column) -> Column:
    """First 16 hex digits of the md5 of `doc::index`."""
    return F.left(F.md5(F.concat_ws("::", doc.cast("string"), index.cast("string"))), F.lit(16))


def content_hash(text: Column) -> Column:
    """sha256 in hex; '' for null and empty text."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit("")).otherwise(F.sha2(text, 256))


def entity_id(doc: Column, name: Column, kind: Column) -> Column:
    return F.concat(F.lit("ent_"), F.left(F.sha2(F.concat_ws("|", doc, name, kind), 256), F.lit(12)))


def mapping_id(category: Column, key: Column) -> Column:
    """Lower-cased first letter of the category, then 12 hex digits."""
    return F.concat(F.lower(F.left(category, F.lit(1))), F.left(F.sha2(F.concat_ws(":", category, key), 256), F.lit(12)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def search_tokens(text: Column) -> Column:
    """Runs of two or more a-z, pairs of neighbours among all CJK characters, and those characters."""

    def with_pairs(cjk: Column) -> Column:
        pairs = F.zip_with(cjk, F.slice(cjk, 2, F.greatest(F.size(cjk), F.lit(1))), lambda a, b: F.concat(a, b))
        return F.concat(F.filter(pairs, lambda p: p.isNotNull()), cjk)

    def tokens(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit("([a-z]{2,})"), F.lit(1))
        cjk = F.filter(F.split(F.regexp_replace(low, "[^一-鿿]", ""), ""), lambda c: c != "")
        return F.when(F.regexp_like(low, F.lit("[一-鿿]")), F.concat(words, let(cjk, with_pairs))).otherwise(words)

    return let(F.lower(F.coalesce(text, F.lit(""))), tokens)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def charset_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct characters; 0 if both have none."""
    chars = lambda x: F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))), F.lit(0.0))


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; 0 where b is 0 or null."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def path_prefixes(path: Column) -> Column:
    """a/b/c gives a, a/b and a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def html_text(html: Column) -> Column:
    """A page's text: no scripts, styles, comments or tags, the common entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def masked_numbers(text: Column, units: list[str], keep_unit: bool = False, name: str = "PARAM") -> Column:
    """Numbers or ranges followed by one of the units become [name], or [name unit]; longest unit first."""
    unit = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    pattern = rf"(\d+(?:\.\d+)?(?:\s*[-~]\s*\d+(?:\.\d+)?)?)\s*({unit})"
    return F.regexp_replace(text, pattern, f"[{name} $2]" if keep_unit else f"[{name}]")

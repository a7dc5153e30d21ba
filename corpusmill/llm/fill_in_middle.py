"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at unit ends, and put together in another order.

An Arrow-batched pandas UDF looks at one text at a time: finditer of the regex library gives the end offsets of all
units, kept in a compact array; two look-ups there give the cuts, and slices the parts. Seeds and digests are hashlib's,
of the document's id, so that a text is cut alike whatever its partition, batch or rerun.

Scale: nothing is shuffled, no key is looked at, and only the id and the text go to Python; a text needs room for itself,
its output and eight bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, documents, quoted, whole

#: A unit is a line with its end, or what follows the last line end.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many are cut, and of those, how many get the suffix first.
RATE, SPM_RATE, SEED = 100, 50, 7
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The end offset of each unit, in code points."""
    return array("q", (m.end() for m in unit.finditer(text)))


def seeds(seed: int, doc_id: str) -> list[int]:
    """The first four 8-digit groups of the sha256 of `seed:doc_id`."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut(text: str, doc_id: str, unit: regex.Pattern, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, lengths of prefix and middle, and the output of one text."""
    ends = unit_ends(text, unit)
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that cut() was given, from its output and form alone: the parts hold no mark, so each is where its mark is."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(marks[0]) :].split(marks[1], 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, with_output: bool = True) -> DataFrame:
    """All columns of docs and the struct `fim`: n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    n counts the matches of unit, left to right. form: plain (the text as it is), psm or spm. output is null unless
    with_output; restored_sha256 is of the text as rebuilt from output and form.

    Null text counts as empty; empty texts and texts that hold a mark are plain. A row without an id has the seed of the
    empty id. Rows are looked at one by one, so repeated rows repeat their result, and an empty table gives an empty one.
    An own column named `fim` is replaced. unit should match every character, or what it leaves out falls to its right.
    """

    @F.pandas_udf(_RESULT)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(unit), []
        for doc, text in zip(ids, texts, strict=True):
            n, form, a, b, output = cut(text, doc, pattern, seed, rate, spm_rate)
            digests = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (output, restored(output, form))]
            rows.append((n, form, a, b, output if with_output else None, *digests))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")])
        return out.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    fim = run(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")), whole(F.col(quoted(text_col))))
    return docs.select(*columns_but(docs, "fim"), fim.alias("fim"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), with_output=False)
    return out.select("doc_id", *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])

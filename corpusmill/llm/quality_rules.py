"""Quality rules: repetition and length rules, then the hashed n-gram log-likelihood ratio between a trusted target and
the raw corpus, length-normalised and compared with one threshold for every document. DataFrame functions only.

Scale: three passes over the texts, none of which shuffles a text, unless there are more than BROADCAST_LABELS labelled
ids to join with them. The passes shuffle bucket counts (at most BUCKETS rows
a task) and score bins. All rules look at one row, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, documents, let, quoted, table, unused, whole, written
from .ngram_lm import LEAST, beside, best_cut, hashed, hashes_of, labelled_sample, log_ratio_sum, log_ratios, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur at least twice. words: a lambda variable, the words' hashes.

    Windows are compared by the 64-bit hash of those within one document. Their hashes are sorted with their positions; equal
    neighbours mark positions, and each marked position covers up to the next one, five words at most.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def marked(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(hit, lambda i: F.get(s, i)["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, marked))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line. text: not null."""
    has = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(has, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_rules(text: Column, ratios: Column | None = None) -> list[Column]:
    """Of a text column (null: empty): w (n_words, n_repeat_words, word_chars and, with ratios, score), n_symbols, n_dup_lines.

    A text is cut into words once for all of w. ratios: as in mean_ratio().
    """
    text = whole(text)

    def of_hashes(x: Column) -> Column:
        w = x["w"]
        fields = [F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), x["chars"].alias("word_chars")]
        return F.struct(*fields, *([] if ratios is None else [mean_ratio(w, x["r"]).alias("score")]))

    def of_words(words: Column) -> Column:
        held = [F.length(F.array_join(words, "")).cast("long").alias("chars"), hashed(words).alias("w"), *([] if ratios is None else [ratios.alias("r")])]
        return let(F.struct(*held), of_hashes)

    return [let(words_of(text), of_words).alias("w"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines")]


def mean_ratio(words: Column, ratios: Column) -> Column:
    """Micro-nats for each word, rounded down; null without words. words: a lambda variable, the words' hashes; ratios: the one array of log_ratios()."""
    return F.floor(F.try_divide(log_ratio_sum(words, ratios), F.size(words)))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.99, least: tuple[float, float] = LEAST) -> DataFrame:
    """All columns of docs and the struct `quality` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, cut, kept).

    labels: id, quality, toxic; good is quality 1 and not toxic. score: micro-nats of ln(target / raw) of its words and
    word pairs, for each word. A document is kept if it doesn't fail the base rules and its score is at least the cut, set on labelled
    rows that the target model has not seen so that at least the share `keep` of the good ones stays. Null text has no
    words and fails. least: as in log_ratios(). Without usable labels there is no cut and the base rules decide. A document of docs' own column
    `quality` is replaced.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    sample = written(labelled_sample(labels, good), "sample")
    ratios = log_ratios(docs, sample, id_col, text_col, least)
    held = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).join(beside(sample.where("__fold = 1")), "__id")
    cut = best_cut(scored(held, "__text", ratios, "s").selectExpr("__good", "s / 1000 as s"), "__good", "s", keep)
    ratio, found = unused(docs, "ratios", "found")
    fields = F.struct(*base_rules(F.col(quoted(text_col)), F.col(ratio)), (cut.scalar() * 1000).cast("long").alias("cut"))
    out = docs.withColumn(ratio, ratios.scalar()).select(*columns_but(docs, "quality"), fields.alias(found))
    q = F.col(found)
    w = q["w"]
    n, r = w["n_words"], w["n_repeat_words"]
    failed = (n < 10) | (100 * r > 20 * n)
    kept = ~failed & F.coalesce(w["score"] >= q["cut"], F.lit(True))
    fields = F.struct(n.alias("n_words"), w["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"), r.alias("n_repeat_words"), failed.alias("base_failed"), w["score"].alias("score"), q["cut"].alias("cut"), kept.alias("kept"))
    return out.select(*columns_but(docs, "quality"), fields.alias("quality"))


def scored(docs: DataFrame, text_col: str, ratios: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`: micro-nats for each word, rounded down; null without words."""
    (table,) = unused(docs, "ratios")
    ask = F.struct(F.col(table).alias("r"), hashes_of(F.col(quoted(text_col))).alias("w"))
    score = let(ask, lambda x: mean_ratio(x["w"], x["r"]))
    return docs.withColumn(table, ratios.scalar()).select(*columns_but(docs), score.alias(name))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cut")])

"""Hashed n-gram multinomials of a trusted target and of the raw corpus, by DataFrame functions alone.

A document's words and word pairs fall into a fixed number of buckets by hash, each kind into its own. Counting them
over the whole corpus shuffles at most one row per bucket and task. The log ratio of each bucket is a whole number of
micro-nats, so that sums don't depend on the order of adding; ratios near 1 count as 1, as most buckets differ between
the two models by chance. The table of all ratios has a fixed size (BUCKETS numbers) whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, whole

#: Buckets of words, of word pairs, and of both.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 20, 1 << 16
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
#: Labelled rows up to which they are broadcast; more are joined by a shuffle of the texts.
BROADCAST_LABELS = 500_000
#: Added to the observed and to the expected target count of a bucket, since rare buckets say little, and the least
#: |ln ratio| that counts; words, pairs.
PRIORS, LEAST = (3.0, 10.0), (1.0, 0.5)
WORDS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.array_remove(F.split(whole(text), WORDS), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hashes_of(text: Column) -> Column:
    """A hash of each word of a text."""
    return hashed(words_of(text))


def buckets_of(hashes: Column) -> Column:
    """The bucket of each word, then of each pair of neighbours. hashes: a lambda variable or a cheap column."""
    one = F.transform(hashes, lambda w: F.pmod(w, F.lit(WORD_BUCKETS)).cast("int"))
    two = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda v, w: F.when(w.isNotNull(), (F.pmod(F.xxhash64(v, w), F.lit(PAIR_BUCKETS)) + WORD_BUCKETS).cast("int")))
    return F.concat(one, F.array_compact(two))


def labelled_sample(labels: DataFrame, good: Column, id_col: str = "doc_id") -> DataFrame:
    """Columns __id, __good, __fold (0: fits the model, 1: sets the threshold): all labelled ids, one row each.

    An id with several labels is good only if all are; null ids and null labels don't count.
    """
    one = labels.select(F.col(id_col).alias("__id"), good.alias("__good")).dropna()
    one = one.groupBy("__id").agg(F.min("__good").alias("__good"))
    return one.withColumn("__fold", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(2)))


def beside(sample: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """sample (written) for a join with texts: broadcast if it is small, or else hashed by parts, so that texts are not sorted."""
    return F.broadcast(sample) if sample.count() <= most else sample.hint("shuffle_hash")


def log_ratios(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, least: tuple[float, float] = LEAST) -> DataFrame:
    """One row with the array `ratios`: for each bucket, micro-nats of ln(target / raw). Raw: all of docs. Target: the good of fold 0.

    least: the least |ln ratio| of words and of pairs that counts; (0, 0) for all.

    Without documents or target words all ratios are 0.
    """
    fit = sample.where(F.col("__good") & (F.col("__fold") == 0)).select("__id", F.lit(1).alias("__fit"))
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).join(beside(fit), "__id", "left")
    grams = rows.select("__fit", F.explode(let(hashes_of(F.col("__text")), buckets_of)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("__fit").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0)
    pair = F.col("b") >= WORD_BUCKETS
    of_kind = lambda c, k: F.sum(F.when(pair == F.lit(bool(k)), F.col(c))).cast("double")
    one = every.agg(*[of_kind(c, k).alias(f"{c}{k}") for c in ("raw", "target") for k in (0, 1)], F.array_sort(F.collect_list(F.struct("b", F.col("raw").alias("r"), F.col("target").alias("t")))).alias("of"))

    def ratio(n: Column) -> Column:
        def of(k: int) -> Column:
            expected = F.try_divide(n["r"] * F.col(f"target{k}"), F.col(f"raw{k}"))
            value = F.log((n["t"] + PRIORS[k]) / (expected + PRIORS[k]))
            return F.when(F.abs(value) >= least[k], F.round(value * 1e6))

        return F.coalesce(F.when(n["b"] < WORD_BUCKETS, of(0)).otherwise(of(1)).cast("int"), F.lit(0))

    return one.select(F.transform("of", ratio).alias("ratios"))


def log_ratio_sum(hashes: Column, ratios: Column) -> Column:
    """Sum over words and word pairs, in micro-nats. hashes: a lambda variable or a cheap column; ratios: the one array of log_ratios().

    Buckets are those of buckets_of(), both of them a power of two, looked up where they are made.
    """
    in_of = lambda h, n: h.bitwiseAND(F.lit(n - 1)).cast("int")

    def both(v: Column, w: Column) -> Column:
        pair = F.get(ratios, in_of(F.xxhash64(v, w), PAIR_BUCKETS) + WORD_BUCKETS)
        return F.get(ratios, in_of(v, WORD_BUCKETS)) + F.when(w.isNotNull(), pair).otherwise(0)

    after = F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1)))
    return F.aggregate(F.zip_with(hashes, after, both), F.lit(0).cast("long"), lambda acc, x: acc + x)


def best_cut(scores: DataFrame, good: str, score: str, keep: float) -> DataFrame:
    """One row with `cut`: the least score that is kept.

    The cut with the largest share of good rows kept plus bad rows dropped, among those that keep at least the share
    `keep` of the good rows; of equal ones the lowest. Scores are binned to 1/1000 before (floor), so that only a
    bounded number of rows are compared however many are scored. Null where there are no good rows.
    """
    bins = scores.groupBy(F.floor(F.col(score) * 1000).alias("bin")).agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("n"))
    has = lambda c: F.when(F.col("bin").isNotNull(), c)  # noqa: E731  no filter: it would be pushed down to all rows' scores
    one = bins.agg(F.array_sort(F.collect_list(has(F.struct("bin", "g", "n")))).alias("bins"), F.sum(has(F.col("g"))).alias("good"), F.sum(has(F.col("n"))).alias("bad"))
    start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("n"), F.lit(-1.0).alias("best"), F.lit(None).cast("long").alias("bin"))

    def step(acc: Column, x: Column) -> Column:
        """acc: rows below this bin; cutting at this bin drops them."""
        kept = 1 - acc["g"] / F.col("good")
        value = F.when(kept >= keep, kept + F.coalesce(F.try_divide(acc["n"].cast("double"), F.col("bad")), F.lit(0.0))).otherwise(F.lit(-1.0))
        better = value > acc["best"]
        return F.struct((acc["g"] + x["g"]).alias("g"), (acc["n"] + x["n"]).alias("n"), F.when(better, value).otherwise(acc["best"]).alias("best"), F.when(better, x["bin"]).otherwise(acc["bin"]).alias("bin"))

    cut = F.when(F.col("good") > 0, F.aggregate("bins", start, step, lambda acc: acc["bin"]) / 1000)
    return one.select(cut.alias("cut"))

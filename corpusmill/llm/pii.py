"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select.

Spans that the fixed base rules accept always stay. Generators propose more (obfuscated mail addresses, national phone
numbers, cards with other separators, IPv6), which may overlap each other and the base; gradient-boosted trees see their
format and the words before them; a threshold for each kind, set on held-out rows, selects. The trees are fitted here
with MLlib on made-up labelled spans and applied as plain column expressions. DataFrame functions only; every step looks
at one row, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_but, documents, let, quoted, whole
from .spans import found, listed, n_of, ordered, running

KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns, possessive where nothing can be given back, and a match begins at the start of
# its run of characters or where the last one ended, so that no text is quadratic.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators, by kind.
MORE = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[(](?:at|AT|@)[\])]|\x20(?:at|AT)\x20)\x20?[A-Za-z0-9-]{1,64}+\x20?(?:[\[(](?:dot|DOT|\.)[\])]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z]{2,24}+",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
]
CUES = [r"(?i)mail|contact|write|reach", r"(?i)\bip\b|host|addr|server|login", r"(?i)card|visa|credit|pay|debit", r"(?i)tel|phone|call|mobile|fax|cell"]
NOT_CUES = r"(?i)order|ref\b|invoice|version|isbn|serial|\bid\b|date|page|total|[#$€£]\s*$"
#: Endings that make a mail address likely.
ENDINGS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|ch|at|nl|be|pl|pt|se"
FEATURES = ["kind", "digits", "length", "marks", "luhn", "cue", "other", "bracket", "zero", "apart", "variety", "suffix"]
#: Made-up spans for fitting and calibration; the precision that a threshold must reach on the held-out third.
TRAIN_ROWS, PRECISION = 3000, 0.95


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.lit(n - i), F.lit(1)).cast("int")
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _card(match: Column) -> Column:
    d = _digits(match)
    return F.length(d).between(14, 19) & luhn(d)


def _ip(match: Column) -> Column:
    return F.regexp_like(match, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"))


def base_spans(text: Column) -> Column:
    """The contract's spans of a text (not null), by start and kind."""
    always = lambda m: F.lit(True)
    return ordered(found(text, 0, EMAIL, always), found(text, 1, IP, _ip), found(text, 2, CARD, _card), found(text, 3, PHONE, lambda m: F.length(_digits(m)).between(10, 15)))


def candidates(text: Column) -> Column:
    return ordered(*[found(text, k, p, lambda m: F.lit(True)) for k, p in enumerate(MORE)])


def features(s: Column) -> dict[str, Column]:
    """Numbers by FEATURES of a span (kind, match, before)."""
    m, d, yes = s["match"], _digits(s["match"]), lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    cue = reduce(lambda acc, k: F.when(s["kind"] == k, F.regexp_like(s["before"], F.lit(CUES[k]))).otherwise(acc), range(4), F.lit(False))
    values = [
        s["kind"].cast("double"), F.length(d).cast("double"), F.length(m).cast("double"), F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")).cast("double"),
        yes(luhn(d)), yes(cue), yes(F.regexp_like(s["before"], F.lit(NOT_CUES))), yes(F.regexp_like(m, F.lit(r"[(\[]"))), yes(F.regexp_like(m, F.lit(r"^\(?0"))),
        yes(F.regexp_like(s["before"], F.lit(r"(?:^|[\s:=,;(])$"))), F.size(F.array_distinct(F.split(d, ""))).cast("double"), yes(F.regexp_like(m, F.lit(rf"(?:\.|(?:dot|DOT)[\])]?\x20?)(?:{ENDINGS})$"))),
    ]
    return dict(zip(FEATURES, values, strict=True))


def training_spans(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Made-up spans with label 0 or 1, the same ones every time: true ones mostly follow a fitting word, others one of orders, dates and versions."""
    pick = lambda salt, values: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))).cast("int"))
    num = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    hexa = lambda salt: F.lower(F.hex(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(65536))))
    word = lambda salt: pick(salt, ["ann", "bob", "kim", "lee", "sales", "info", "joe.doe", "mail0", "example", "site", "corp"])
    y, kind = F.col("label"), F.col("kind")
    sep, dot = pick("sep", ["-", ".", " "]), pick("dot", [".", "_", "/"])
    body = num("c1", 4), num("c2", 4), num("c3", 4), num("c4", 3)
    fifteen = F.concat(*body)
    check = reduce(lambda acc, d: F.when(luhn(F.concat(fifteen, F.lit(str(d)))), F.lit(str(d))).otherwise(acc), range(10), F.lit("0"))
    wrong = F.pmod(check.cast("int") + 1 + F.pmod(F.xxhash64("id", F.lit("w")), F.lit(9)), F.lit(10)).cast("string")
    card = F.concat(body[0], dot, body[1], dot, body[2], dot, body[3], F.when(y == 1, check).otherwise(wrong))
    at = pick("at", [" (at) ", "[at]", " at ", "(at)"])
    mail = F.concat(word("u"), at, word("h"), F.when(y == 1, pick("d1", ["[dot]", " dot ", "."])).otherwise(pick("d2", [".", " dot "])), F.when(y == 1, pick("tld", ["com", "org", "net", "de"])).otherwise(pick("end", ["there", "then", "line", "where"])))
    six = F.when(y == 1, F.concat_ws(":", *[hexa(f"h{i}") for i in range(8)])).otherwise(F.concat_ws(":", num("t1", 2), num("t2", 2), num("t3", 2), num("t4", 2)))
    phone = F.when(y == 1, F.concat(pick("p", ["(", ""]), num("a", 3), F.when(pick("p", ["(", ""]) == "(", ") ").otherwise(sep), num("b", 3), sep, num("c", 4))).otherwise(F.concat(num("a", 4), sep, num("b", 4), sep, num("c", 4)))
    good = reduce(lambda acc, k: F.when(kind == k, pick(f"g{k}", [["mail: ", "contact ", "write to "], ["host ", "server: ", "ip "], ["card ", "visa: ", "pay with "], ["tel. ", "phone: ", "call "]][k])).otherwise(acc), range(4), F.lit(""))
    odd = pick("o", ["order ", "invoice #", "version ", "serial ", "total $", "date "])
    sure = F.pmod(F.xxhash64("id", F.lit("sure")), F.lit(5)) > 0
    before = F.when(sure & (y == 1), good).when(sure, odd).otherwise(pick("n", ["the ", "and ", "of "]))
    match = F.when(kind == 0, mail).when(kind == 1, six).when(kind == 2, card).otherwise(phone)
    base = spark.range(rows, numPartitions=1).select("id", (F.col("id") % 4).cast("int").alias("kind"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("label"))
    return base.select("id", "label", F.struct(kind.alias("kind"), match.alias("match"), before.alias("before")).alias("s"))


def fit(spark: SparkSession, rows: int = TRAIN_ROWS, trees: int = 8, depth: int = 3) -> tuple[list[tuple[float, object]], list[float]]:
    """The trees with their weights, and the least score for each kind: the lowest cut with PRECISION on held-out rows."""
    named = training_spans(spark, rows).select("id", "label", "s")
    table = named.select("id", "label", *[c.alias(n) for n, c in features(F.col("s")).items()])
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(table.where("id % 3 > 0"))
    held = model.transform(table.where("id % 3 = 0")).select("kind", "label", vector_to_array("rawPrediction")[1].alias("score"))
    cuts = [float("inf")] * 4
    ranked: dict[int, list[tuple[float, float]]] = {k: [] for k in range(4)}
    for x in held.collect():  # a third of TRAIN_ROWS
        ranked[int(x["kind"])].append((x["score"], x["label"]))
    for k, pairs in ranked.items():
        right = n = 0.0
        for score, own in groupby(sorted(pairs, reverse=True), key=lambda x: x[0]):  # equal scores stay together
            labels = [label for _, label in own]
            right, n = right + sum(labels), n + len(labels)
            if right / n >= PRECISION and score > 0:
                cuts[k] = score
    return [(w, _tree(t.toDebugString)) for t, w in zip(model.trees, model.treeWeights, strict=True)], cuts


def _tree(described: str) -> object:
    """A tree as nested (feature, threshold, left, right), or a number, from its description."""
    lines = [x.strip() for x in described.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[object, int]:
        if lines[i].startswith("Predict:"):
            return float(lines[i].split()[1]), i + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", lines[i]).groups()
        left, j = node(i + 1)
        right, j = node(j + 1)
        return (int(feature), float(limit), left, right), j

    return node(0)[0]


def score(trees: list[tuple[float, object]], f: Column) -> Column:
    """The sum of the trees as a column. f: a struct with FEATURES."""

    def of(t: object) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(f[FEATURES[t[0]]] <= t[1], of(t[2])).otherwise(of(t[3]))

    return reduce(lambda a, b: a + b, [F.lit(w) * of(t) for w, t in trees])


#: Candidates, in the order of their starts, among which are all that can touch one: they have 7 to 170 characters, and
#: those of one kind don't touch each other.
NEAR = 160


def _untouched(base: Column, rated: Column) -> Column:
    """Those of rated (s, score) that touch no span of base: none that begins before their end ends after their start."""
    last = F.lit(None).cast("struct<start:int,kind:int,stop:int,match:string,before:string>")
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["stop"].alias("stop"), last.alias("s"), F.lit(0.0).alias("score")))
    of_more = F.transform(rated, lambda c: F.struct(c["s"]["stop"].alias("at"), F.lit(0).alias("base"), F.lit(0).alias("stop"), c["s"].alias("s"), c["score"].alias("score")))

    def free(events: Column) -> Column:
        def kept(reach: Column) -> Column:
            return F.array_compact(F.transform(events, lambda e, i: F.when((e["base"] == 0) & (F.get(reach, i) <= e["s"]["start"]), F.struct(e["s"].alias("s"), e["score"].alias("score")))))

        return let(running(F.transform(events, lambda e: e["stop"]), F.greatest), kept)

    return let(F.array_sort(F.concat(of_base, of_more)), free)


def select_spans(base: Column, more: Column, trees: list, cuts: list[float]) -> Column:
    """base with those of more (a lambda variable or cheap column) that reach their kind's cut, don't touch a base span and don't touch a better or earlier one."""
    rated = F.transform(more, lambda s: F.struct(s.alias("s"), let(F.struct(*[c.alias(n) for n, c in features(s).items()]), lambda f: score(trees, f)).alias("score")))
    cut = lambda kind: F.get(F.array(*map(F.lit, cuts)), kind)
    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    rank = lambda x: F.struct((-x["score"]).alias("a"), x["s"]["start"].alias("b"), x["s"]["kind"].alias("c"))

    def choose(x: Column) -> Column:
        free = F.array_sort(_untouched(x["b"], F.filter(x["r"], lambda c: c["score"] >= cut(c["s"]["kind"]))))

        def best(all_: Column) -> Column:
            beaten = lambda c, i: F.exists(F.slice(all_, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1)), lambda o: meets(c["s"], o["s"]) & (rank(o) < rank(c)))
            return F.array_compact(F.transform(all_, lambda c, i: F.when(~beaten(c, i), c["s"])))

        return ordered(x["b"], let(free, best))

    return F.when(F.size(more) == 0, base).otherwise(let(F.struct(rated.alias("r"), base.alias("b")), choose))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and the struct `pii` (base, spans: arrays of start, kind, stop, match, before).

    Null text counts as empty; empty text has no spans. Rows are looked at one by one, so repeated rows repeat their
    result and an empty table gives an empty one. An own column named `pii` is replaced.
    """
    trees, cuts = fit(docs.sparkSession)
    text = whole(F.col(quoted(text_col)))
    both = F.struct(base_spans(text).alias("b"), candidates(text).alias("m"))
    pii = let(both, lambda x: F.struct(x["b"].alias("base"), select_spans(x["b"], x["m"], trees, cuts).alias("spans")))
    return docs.select(*columns_but(docs, "pii"), pii.alias("pii"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; of spans that touch, the first is replaced."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], gap, F.get(names, s["kind"])).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("pii.base")
    counts = [n_of(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(base, KINDS), 256).alias("base_sha256"), listed(F.col("pii.spans"), KINDS).alias("spans"))

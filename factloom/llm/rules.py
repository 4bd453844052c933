"""Quality rules: robust multivariate outliers among text statistics, per language and source.

Statistics of a text become a vector of five transformed figures. For each language and source a minimum
covariance determinant estimate (deterministic start from medians and median deviations, then concentration
steps) says what is usual there; a text too far from it by Mahalanobis distance is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import BLANK_CHARS, beside, bind, staged, without, word_list

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

FEATURES = 5
# Share of the documents an estimate rests on, and how often it is concentrated.
CORE = 0.5
STEPS = 4
# An estimate of fewer documents is mixed with that of the language (a language's with that of all documents) by its
# share of this number, so that no verdict hangs on one document more or less.
LEAST_GROUP = 200
# Features are held in thousandths as integers: sums are exact, whatever the order.
SCALE = 1000
# Deviations below this are no reason to reject: a floor of the standard deviations, in feature units.
FLOOR = (0.35, 0.08, 0.25, 0.30, 0.30)
# Chance of a usual document to be rejected if features were normal.
CHANCE = 1e-9
# Parts of a doubling of the squared distance in which documents are counted.
FINE = 16


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_point(p: int, share: float) -> float:
    """The value below which a chi-square variable with ``p`` degrees lies with chance ``share``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_share(p / 2, mid / 2) < share else (low, mid)
    return high


def consistency(p: int = FEATURES, core: float = CORE) -> float:
    """Factor that makes the covariance of the core of normal data that of all."""
    return core / _gamma_share(p / 2 + 1, chi2_point(p, core) / 2)


def _repeated(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; ``windows``: hash of the window at each place.

    Sorted by hash, a window that occurs again has a neighbour alike; places in order cover three words each, or as
    many as lie before the next one. No array grows step by step, so a text of repeats costs what sorting it does.
    """

    def alike(placed: Column) -> Column:
        near = lambda k, x: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        return F.filter(placed, lambda x, k: near(k - 1, x) | near(k + 1, x))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.array_sort(F.transform(bind(placed, alike), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda acc, n: acc + n)
    return bind(places, covered)


def with_statistics(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of each row as ``doc``, with ``lang``, ``source`` and its statistics.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``. Windows are
    told apart by 64-bit hashes. Null and empty texts have no words and fail.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(docs["text"], F.lit(""))
    doc = F.struct(*[docs[f"`{c}`"] for c in keep]) if keep else F.lit(None).cast("struct<none:string>")
    a = docs.select(
        doc.alias("doc"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"),
        word_list(docs["text"]).alias("words"), F.length(without(text, BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, BLANK_CHARS, " " * len(BLANK_CHARS))) != "").alias("lines"),
    )
    hashed = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    b = a.select("*", F.size("words").cast("long").alias("n_words"), hashed.alias("hashes"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("words", "lines")
    triples = F.when(F.col("n_words") >= 3, F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.element_at("hashes", i + 2), F.element_at("hashes", i + 3)))).otherwise(F.array().cast("array<bigint>"))
    c = b.select("*", triples.alias("windows")).drop("hashes")
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_repeated(F.col("windows")))
    d = c.select("*", repeats.alias("n_repeat_words")).drop("windows")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    # Behind a generator of one row: a condition on statistics cannot be moved below them, to compute them again.
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    e = d.select("doc", "lang", "source", F.inline(F.array(F.struct(*names))))
    return e.select("*", failed.alias("base_failed"))


def features() -> list[Column]:
    """The transformed figures, in thousandths: length, word length, symbols, repeated lines, repeated words."""
    n, chars = F.col("n_words"), F.col("word_chars")
    raw = [
        F.log1p(n), F.ln((1.0 + chars) / (1.0 + n)), F.log1p(100.0 * F.col("n_symbols") / (1.0 + chars)),
        F.log1p(100.0 * F.col("n_dup_lines") / (10.0 + n)), F.log1p(10.0 * F.col("n_repeat_words") / (1.0 + n)),
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.when(p.isNull(), "-").otherwise(F.concat(F.lit("+"), p)) for p in parts])


_X = [f"x{i}" for i in range(FEATURES)]
_M = [f"m{i}" for i in range(FEATURES)]
_PAIRS = [(i, j) for i in range(FEATURES) for j in range(i + 1)]
_L = {(i, j): f"l{i}{j}" for i, j in _PAIRS}


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` to centre ``m`` with the Cholesky factor ``l``, by forward substitution."""
    ys: list[Column] = []
    for i in range(FEATURES):
        y = F.col(_X[i]) / float(SCALE) - F.col(_M[i])
        for j in range(i):
            y = y - F.col(_L[i, j]) * ys[j]
        ys.append(y / F.col(_L[i, i]))
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Centre and scale of each key from medians and median deviations; the first core is a ball in these units."""
    long = rows.select("key", F.posexplode(F.array(*_X)).alias("i", "x"))
    counts = staged(long.groupBy("key", "i", "x").agg(F.count("*").alias("n")), "rules-counts")

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        upto = W.partitionBy("key", "i").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        half = df.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("key", "i")))
        return half.where(2 * F.col("upto") >= F.col("all")).groupBy("key", "i").agg(F.min(value).alias(name))

    centre = median(counts, "x", "m")
    away = counts.join(centre, ["key", "i"]).groupBy("key", "i", F.abs(F.col("x") - F.col("m")).alias("away")).agg(F.sum("n").alias("n"))
    spread = median(away, "away", "mad").join(centre, ["key", "i"])
    pick = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name))) / float(SCALE)
    wide = spread.groupBy("key").agg(*[pick("m", i).alias(_M[i]) for i in range(FEATURES)], *[pick("mad", i).alias(f"d{i}") for i in range(FEATURES)])
    scale = [F.greatest(F.lit(1.4826) * F.col(f"d{i}"), F.lit(FLOOR[i])).alias(_L[i, i]) for i in range(FEATURES)]
    none = [F.lit(0.0).alias(_L[i, j]) for i, j in _PAIRS if i != j]
    return wide.select("key", *_M, *scale, *none)


def _concentrated(rows: DataFrame, estimate: DataFrame, factor: float) -> DataFrame:
    """One concentration step: mean and covariance of the documents of each key nearest to its estimate.

    Distances fall into fine classes; sums are taken per key and class, and classes are taken in until they hold
    the core. So no key's documents are sorted or meet in one task.
    """
    near = rows.join(estimate, "key").select("key", *_X, F.floor(FINE * F.log2(F.lit(1e-6) + _distance())).cast("int").alias("band"))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS]
    bands = near.groupBy("key", "band").agg(F.count("*").alias("n"), *sums)
    all_of, before = W.partitionBy("key"), W.partitionBy("key").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    core = bands.withColumn("all", F.sum("n").over(all_of)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < CORE * F.col("all"))
    names = [f"s{i}" for i in range(FEATURES)] + [f"q{i}{j}" for i, j in _PAIRS]
    total = core.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in names])
    mean = total.select("*", *[(F.col(f"s{i}") / F.col("n") / float(SCALE)).alias(_M[i]) for i in range(FEATURES)])
    cov = {(i, j): factor * (F.col(f"q{i}{j}") / F.col("n") / float(SCALE * SCALE) - F.col(_M[i]) * F.col(_M[j])) + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    out = mean.select("key", *_M, *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()])
    return staged(_factored(out).select("key", *_M, *_L.values()), "rules-estimate")


def _factored(df: DataFrame) -> DataFrame:
    """``df`` with the Cholesky factor of its covariances, column by column; the floor keeps the diagonal above zero."""
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(_L[i, k]) * F.col(_L[j, k])
        value = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(_L[j, j])
        df = df.withColumn(_L[i, j], value)
    return df


def _mixed(df: DataFrame, share: str, own: str, wide: str, out: str) -> DataFrame:
    """``df`` with the estimate ``own`` taken for ``share`` and ``wide`` for the rest, in columns that start with ``out``."""
    w, v = F.col(share), 1 - F.col(share)
    means = [(w * F.col(own + m) + v * F.col(wide + m)).alias(out + m) for m in _M]
    covs = [(w * F.col(f"{own}c{i}{j}") + v * F.col(f"{wide}c{i}{j}")).alias(f"{out}c{i}{j}") for i, j in _PAIRS]
    return df.select("*", *means, *covs)


def estimates(stats: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """``group`` (language and source) with the centre and Cholesky factor that judge it.

    stats: of ``with_statistics``, staged. Estimates rest on the documents that pass the base rules. Null
    languages and sources are groups of their own.
    """
    narrow = stats.where("not base_failed").select("lang", "source", *[x.alias(n) for x, n in zip(features(), _X)])
    levels = F.array(F.lit("all"), F.concat(F.lit("lang:"), _key(F.col("lang"))), F.concat(F.lit("both:"), _key(F.col("lang"), F.col("source"))))
    rows = narrow.select(F.explode(levels).alias("key"), *_X)
    estimate, factor = staged(_start(rows), "rules-start"), consistency()
    for _ in range(STEPS):
        estimate = _concentrated(rows, estimate, factor)
    # One row a group: its estimate, its language's and that of all, mixed by the numbers of documents.
    of = {(i, j): sum(F.col(_L[i, k]) * F.col(_L[j, k]) for k in range(j + 1)) for i, j in _PAIRS}
    spelt = lambda x: estimate.select(F.col("key").alias(f"{x}key"), *[F.col(m).alias(x + m) for m in _M], *[c.alias(f"{x}c{i}{j}") for (i, j), c in of.items()])
    upto = lambda n: F.least(F.lit(1.0), n / F.lit(float(least_group)))
    groups = narrow.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("n_lang", F.sum("n").over(W.partitionBy("lang")))
    named = groups.select(_key(F.col("lang"), F.col("source")).alias("group"), F.concat(F.lit("both:"), _key(F.col("lang"), F.col("source"))).alias("o_key"), F.concat(F.lit("lang:"), _key(F.col("lang"))).alias("l_key"), upto(F.col("n")).alias("w_group"), upto(F.col("n_lang")).alias("w_lang"))
    joined = named.join(spelt("o_"), "o_key").join(spelt("l_"), "l_key").crossJoin(F.broadcast(spelt("a_").where("a_key = 'all'")))
    mixed = _mixed(_mixed(joined, "w_lang", "l_", "a_", "u_"), "w_group", "o_", "u_", "")
    return staged(_factored(mixed).select("group", *_M, *_L.values()), "rules-used")


def judged_by(stats: DataFrame, used: DataFrame, chance: float = CHANCE) -> DataFrame:
    """``stats`` with ``distance`` (squared, null where the base rules fail) and ``kept``."""
    sized = stats.select("*", *[x.alias(n) for x, n in zip(features(), _X)], _key(F.col("lang"), F.col("source")).alias("group"))
    far = F.when(~F.col("base_failed"), _distance())
    found = sized.join(beside(used), "group", "left").select(*stats.columns, far.alias("distance"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_point(FEATURES, 1 - chance)))


def judged(stats: DataFrame, least_group: int = LEAST_GROUP, chance: float = CHANCE) -> DataFrame:
    """``stats`` (of ``with_statistics``, staged) judged by estimates from themselves."""
    return judged_by(stats, estimates(stats, least_group), chance)


def assess(docs: DataFrame, keep: Sequence[str] | None = None, least_group: int = LEAST_GROUP, chance: float = CHANCE) -> DataFrame:
    """The kept columns of each row as ``doc``, with its statistics, ``base_failed``, ``distance`` and ``kept``.

    docs: ``text``, ``lang`` and ``source``, any other columns. Rows stay one by one, repeated ones too.
    """
    return judged(staged(with_statistics(docs, keep), "rules-statistics"), least_group, chance)


def good(docs: DataFrame, least_group: int = LEAST_GROUP, chance: float = CHANCE) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    Texts are read twice, for the estimates and for the verdicts, so that no second copy of them is written.
    """
    used = estimates(staged(with_statistics(docs, ()), "rules-statistics"), least_group)
    return judged_by(with_statistics(docs), used, chance).where("kept").select("doc.*")

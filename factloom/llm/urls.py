"""URL filters: rules by host and path, and for the rest a character language model of accepted and rejected URLs.

The URLs that the rules decide are the two samples. Each class has a variable-order Markov model: the chance of a
character after the longest known context, smoothed by shorter ones. A URL is allowed when its log-likelihood
ratio per character reaches a threshold calibrated on URLs whose own half of the data the model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import staged

# Fixed rules: verdict, host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Longest context in characters, weight of the shorter context, number of characters that the shortest assumes.
ORDER = 5
TRUST = 4.0
ALPHABET = 256
# Marks before and after a text; no URL part holds them.
START, END = "\x02", "\x03"
# Calibration looks at scores in steps of this size.
GRID = 0.01


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    valid = url.isNotNull() & (at > 0)
    return F.when(valid, low).otherwise(F.lit("")), F.when(valid, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """For each character of a text and its end mark: up to ORDER characters before it, and the character."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(ORDER + 1)))


_CELLS = ("allow0", "allow1", "block0", "block1")


def model(strings: DataFrame) -> DataFrame:
    """Counts of every gram of every order: ``gram`` (context and character) and its context's, per class and half.

    strings: distinct ``text`` with ``verdict`` (allow or block), ``half`` (0 or 1) and ``n`` (URLs with it).
    """
    full = strings.select("verdict", "half", "n", F.explode(_grams(F.col("text"))).alias("full")).groupBy("full").agg(
        *[F.sum(F.when((F.col("verdict") == c[:-1]) & (F.col("half") == int(c[-1])), F.col("n")).otherwise(F.lit(0))).alias(c) for c in _CELLS]
    )
    full = staged(full, "url-grams")
    orders = full.select(F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"), "full", *_CELLS)
    grams = orders.groupBy("k", F.expr("right(full, k + 1)").alias("gram")).agg(*[F.sum(c).alias(c) for c in _CELLS])
    grams = staged(grams.select("*", F.expr("left(gram, k)").alias("context")), "url-orders")
    contexts = grams.groupBy("k", "context").agg(*[F.sum(c).alias(f"{c}_all") for c in _CELLS])
    return staged(grams.join(contexts, ["k", "context"]).select("k", "gram", *_CELLS, *[f"{c}_all" for c in _CELLS]), "url-model")


def _chance(steps: Column, verdict: str, halves: Sequence[int]) -> Column:
    """Chance of the character: from the shortest context to the longest, each smoothed by the one before.

    steps: by order, the counts; an order missing from the model says nothing.
    """

    def total(x: Column, suffix: str) -> Column:
        out = x[f"{verdict}{halves[0]}{suffix}"]
        for h in halves[1:]:
            out = out + x[f"{verdict}{h}{suffix}"]
        return out.cast("double")

    return F.aggregate(steps, F.lit(1.0 / ALPHABET), lambda p, x: (total(x, "") + TRUST * p) / (total(x, "_all") + TRUST))


def scores(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """Log-likelihood ratio per character of each ``text`` by its ``string_no``: ``score`` by all, ``score0`` and ``score1`` by one half alone.

    Grams are distinct before they meet the model, so frequent hosts cost nothing more there.
    """
    places = strings.select("string_no", F.explode(_grams(F.col("text"))).alias("full"))
    asked = places.select("full").distinct()
    orders = asked.select("full", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).select("full", "k", F.expr("right(full, k + 1)").alias("gram"), F.expr("left(right(full, k + 1), k)").alias("context"))
    own = counts.select("k", "gram", *_CELLS)
    whole = counts.select("k", F.expr("left(gram, k)").alias("context"), *[f"{c}_all" for c in _CELLS]).distinct()
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in (*_CELLS, *[f"{c}_all" for c in _CELLS])]
    known = orders.join(whole, ["k", "context"]).join(own, ["k", "gram"], "left").select("full", "k", *none)
    # Six rows a gram at most, one for each order.
    steps = F.array_sort(F.collect_list(F.struct("k", *_CELLS, *[f"{c}_all" for c in _CELLS])))
    per_gram = known.groupBy("full").agg(steps.alias("steps"))

    def ratio(halves: Sequence[int]) -> Column:
        return F.ln(_chance(F.col("steps"), "allow", halves)) - F.ln(_chance(F.col("steps"), "block", halves))

    valued = staged(per_gram.select("full", ratio((0, 1)).alias("r"), ratio((0,)).alias("r0"), ratio((1,)).alias("r1")), "url-ratios")
    # A gram that many URLs hold (a common host) meets its one row in parts: the other side is repeated for each.
    parts = 16
    spread = places.withColumn("part", F.pmod("string_no", F.lit(parts)).cast("int"))
    copies = valued.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    exact = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,9)"))
    met = spread.join(copies, ["full", "part"], "left").groupBy("string_no").agg(exact("r").alias("s"), exact("r0").alias("s0"), exact("r1").alias("s1"), F.count("*").alias("n"))
    return met.select("string_no", *[(F.col(a).cast("double") / F.col("n")).alias(b) for a, b in (("s", "score"), ("s0", "score0"), ("s1", "score1"))])


def threshold(scored: DataFrame) -> float:
    """The score from which on allowing agrees best with the rules, each class weighing the same.

    scored: ``held`` (score by the half that a URL is not in), ``verdict`` and ``n``. Without URLs of both classes
    it is zero. Scores are counted on a grid, so the sums run over a bounded number of rows.
    """
    steps = F.least(F.greatest(F.floor(F.col("held") / GRID), F.lit(-3000)), F.lit(3000)).cast("int")
    cells = scored.groupBy(steps.alias("step")).agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(F.lit(0))).alias(v) for v in ("allow", "block")])
    upto, every = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    share = lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0)) / F.nullif(F.sum(v).over(every), F.lit(0))
    # Allowing from a step on loses the allowed below it and keeps out the blocked below it.
    gain = cells.select("step", (share("block") - share("allow")).alias("gain"))
    best = gain.agg(F.max(F.struct(F.round("gain", 12).alias("gain"), (-F.abs("step")).alias("near"), "step")).alias("b"))
    b = best.first()["b"]
    return b["step"] * GRID if b is not None and b["gain"] is not None else 0.0


def judge(pages: DataFrame, keep: Sequence[str] | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The kept columns of each row as ``page``, with ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``threshold``.

    pages: ``url``, any other columns. A null URL and one without ``://`` have empty host and path and are judged
    by the method like any other text without a rule. Repeated URLs weigh as often as they occur. Without rows of
    both classes the threshold is zero. Rows stay one by one.
    """
    keep = pages.columns if keep is None else keep
    host, path = split_url(pages["url"])
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in keep]).alias("page"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = staged(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text")), "url-rows")
    # The halves are by text, so copies of a URL are in one half.
    strings = staged(rows.groupBy("text").agg(F.count("*").alias("n"), F.first("ruled").alias("verdict")).select("*", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), F.monotonically_increasing_id().alias("string_no")), "url-strings")
    counts = model(strings.where("verdict is not null"))
    scored = staged(strings.join(scores(strings, counts), "string_no"), "url-scores")
    held = scored.where("verdict is not null").select("verdict", "n", F.when(F.col("half") == 0, F.col("score1")).otherwise(F.col("score0")).alias("held"))
    cut = F.lit(threshold(held))
    # All rows without host and path have one text, and one score.
    none = scored.where("text = ''").select("score").first()
    listed = rows.where("text <> ''").join(scored.select("text", "score"), "text")
    judged = listed.unionByName(rows.where("text = ''").withColumn("score", F.lit(none["score"] if none else None).cast("double")))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select("page", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", cut.alias("threshold"))

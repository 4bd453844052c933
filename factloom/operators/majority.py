"""Literals that make a claim about most rows true. All return (by, filled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import number_text
from factloom.keyed import KeyedTable
from factloom.operators import ngrams
from factloom.operators.values import lower_bounds, upper_bounds, value_counts, value_profile
from factloom.plans.ranking import join_on


def table_rows(t: KeyedTable) -> DataFrame:
    return t.df.groupBy(*t.by).agg(F.count(F.lit(1)).alias("n_rows"))


def _half(n):
    return F.floor(F.col(n) / 2)


def most_eq(t: KeyedTable, col: str) -> DataFrame:
    """Values held by more than half of the rows but not all of them; a table without one falls back
    to the frequent n-grams of the column."""
    totals = table_rows(t)
    usual = (F.col("c") > F.col("n_rows") / 2) & (F.col("c") < F.col("n_rows"))
    values = join_on(value_counts(t, col).withColumnRenamed("cnt", "c"), totals, t.by)
    main = values.where(usual & F.col("one_raw")).select(*t.by, F.col("raw").alias("filled"))
    if not t.is_string(col) and not t.has_raw(col):
        return main
    grams = ngrams.frequent_ngrams(t, col).select(*t.by, "gram", F.col("freq").alias("c"))
    fallback = join_on(grams, totals, t.by).where(usual).select(*t.by, F.col("gram").alias("filled"))
    settled = main.select(*t.by).distinct()
    if not t.by:
        settled, fallback = settled.select(F.lit(1).alias("__k")), fallback.withColumn("__k", F.lit(1))
        return main.unionByName(join_on(fallback, settled, ["__k"], "left_anti").drop("__k"))
    return main.unionByName(join_on(fallback, settled, t.by, "left_anti"))


def most_not_eq(t: KeyedTable, col: str) -> DataFrame:
    """Values that more than half of the rows do not hold."""
    values = join_on(value_counts(t, col).where("one_raw"), table_rows(t), t.by)
    rare = F.col("n_rows") - F.col("cnt") > F.col("n_rows") / 2
    return values.where(rare).select(*t.by, F.col("raw").alias("filled"))


def most_greater(t: KeyedTable, col: str) -> DataFrame:
    """Round bounds below the lower half of the values that most, but not all, values exceed."""
    bounds = lower_bounds(t, col).where(F.col("lowest") < _half("n"))
    most = (F.col("beyond") > _half("n")) & (F.col("beyond") < F.col("n"))
    return bounds.where(most).select(*t.by, number_text(F.col("bound")).alias("filled"))


def most_less(t: KeyedTable, col: str) -> DataFrame:
    """Round bounds above the upper half of the values that most, but not all, values stay below."""
    bounds = upper_bounds(t, col).where(F.col("highest") < _half("n"))
    most = (F.col("beyond") > _half("n")) & (F.col("beyond") < F.col("n"))
    return bounds.where(most).select(*t.by, number_text(F.col("bound")).alias("filled"))


def most_greater_eq(t: KeyedTable, col: str) -> DataFrame:
    """Values of the lower half without the first cell."""
    first = F.greatest(F.col("below"), F.lit(1))
    last = F.least(F.col("upto"), _half("n")) - 1
    return value_profile(t, col).where(first <= last).select(*t.by, F.col("raw").alias("filled"))


def most_less_eq(t: KeyedTable, col: str, full_half: bool = False) -> DataFrame:
    """The first two values of the upper half (its only value for a one-row column).

    ``full_half=True`` gives the whole upper half without the last cell.
    """
    start = F.col("n") - _half("n")
    if full_half:
        low, high = start, F.col("n") - 2
    else:
        low = F.when(F.col("n") == 1, F.lit(0)).otherwise(start)
        high = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least(start + 1, F.col("n") - 1))
    hit = F.greatest(F.col("below"), low) <= F.least(F.col("upto") - 1, high)
    return value_profile(t, col).where(hit).select(*t.by, F.col("raw").alias("filled"))

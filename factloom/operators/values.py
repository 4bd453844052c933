"""The value relation of a column: one row per table and distinct value.

Most operators are a filter or a projection over it, so a column is aggregated once (with map-side
combine) and only distinct values are shuffled, ranked and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import ceil_to, digit_order, floor_to, step_of
from factloom.keyed import KeyedTable
from factloom.plans.ranking import join_on, running


def value_counts(t: KeyedTable, col: str) -> DataFrame:
    """(by, v, cnt, raw, one_raw): ``raw`` is the smallest original text of the value and ``one_raw``
    tells whether it is the only one. Empty cells are the value null."""
    v, cnt = t.value(col).alias("v"), F.sum("__rows").alias("cnt")
    if t.has_raw(col):
        texts = [F.min("r").alias("raw"), (F.min("r") == F.max("r")).alias("one_raw")]
        rows = t.df.select(*t.by, v, t.text(col).alias("r"), t.weighed())
        return rows.groupBy(*t.by, "v").agg(cnt, *texts)
    counts = t.df.select(*t.by, v, t.weighed()).groupBy(*t.by, "v").agg(cnt)
    return counts.select(
        "*", t.text_of_value(col, F.col("v")).alias("raw"), F.lit(True).alias("one_raw")
    )


def value_profile(t: KeyedTable, col: str) -> DataFrame:
    """Non-null values with ``upto`` (rows with a value <= v), ``below`` (rows < v) and ``n`` (all
    non-null rows)."""
    return running(
        value_counts(t, col).where(F.col("v").isNotNull()),
        t.by,
        ["v"],
        sums={"upto": F.col("cnt")},
        totals={"n": ("sum", F.col("cnt"))},
    ).withColumn("below", F.col("upto") - F.col("cnt"))


def range_step(t: KeyedTable, col: str) -> DataFrame:
    """(by, step): rounding step from the most frequent number of digits, ties to the longer."""
    numbers = value_counts(t, col).where(F.col("v").isNotNull())
    orders = (
        numbers.select(*t.by, F.abs(F.col("v").cast("double")).alias("a"), "cnt")
        .groupBy(*t.by, digit_order(F.col("a")).alias("digits"))
        .agg(F.sum("cnt").alias("cnt"), F.max("a").alias("largest"))
    )
    usual = orders.groupBy(*t.by).agg(F.max(F.struct("cnt", "digits", "largest")).alias("u"))
    return usual.select(*t.by, step_of(F.col("u.digits"), F.col("u.largest")).alias("step"))


def lower_bounds(t: KeyedTable, col: str) -> DataFrame:
    """(by, bound, beyond, n, lowest): round bounds below the values and the rows above each.

    A bound belongs to the values of one step, so the rows up to it are the smallest running count in
    that step: no comparison of values with bounds is needed. ``lowest`` is the number of rows below
    the first value that has the bound.
    """
    profile = join_on(value_profile(t, col), range_step(t, col), t.by)
    v = F.col("v").cast("double")
    stepped = profile.select(*t.by, "n", "upto", "below", v.alias("v"), floor_to(v, F.col("step")).alias("bound"))
    upto_bound = F.when(F.col("v") <= F.col("bound"), F.col("upto")).otherwise(F.col("below"))
    return (
        stepped.groupBy(*t.by, "bound")
        .agg(F.min(upto_bound).alias("under"), F.max("n").alias("n"), F.min("below").alias("lowest"))
        .withColumn("beyond", F.col("n") - F.col("under"))
        .drop("under")
    )


def upper_bounds(t: KeyedTable, col: str) -> DataFrame:
    """Mirror of ``lower_bounds``: round bounds above the values and the rows below each; ``highest``
    is the number of rows above the last value that has the bound."""
    profile = join_on(value_profile(t, col), range_step(t, col), t.by)
    v = F.col("v").cast("double")
    stepped = profile.select(*t.by, "n", "upto", ceil_to(v, F.col("step")).alias("bound"))
    return (
        stepped.groupBy(*t.by, "bound")
        .agg(F.max("upto").alias("beyond"), F.max("n").alias("n"))
        .withColumn("highest", F.col("n") - F.col("beyond"))
    )


def raw_forms(t: KeyedTable, col: str) -> DataFrame:
    """(by, v, form, smallest): every original text of every value, one row each."""
    forms = t.df.select(*t.by, t.value(col).alias("v"), t.text(col).alias("form")).distinct()
    smallest = forms.groupBy(*t.by, "v").agg(F.min("form").alias("smallest"))
    return join_on(forms, smallest, [*t.by, "v"])

"""Literals that make a claim about all rows true. All return (by, filled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import ceil_to, floor_to, number_text
from factloom.keyed import KeyedTable
from factloom.operators import ngrams
from factloom.operators.majority import table_rows
from factloom.operators.superlatives import col_max, col_min
from factloom.operators.values import range_step, value_counts
from factloom.plans.ranking import join_on


def all_eq(t: KeyedTable, col: str) -> DataFrame:
    """Values and frequent n-grams that occur as often as there are rows; a text that is both adds
    its two counts."""
    values = value_counts(t, col).select(*t.by, F.col("raw").alias("filled"), F.col("cnt").alias("c"), "one_raw")
    if t.is_string(col) or t.has_raw(col):
        grams = ngrams.frequent_ngrams(t, col).select(
            *t.by, F.col("gram").alias("filled"), F.col("freq").alias("c"), F.lit(True).alias("one_raw")
        )
        values = values.unionByName(grams)
        if t.is_string(col):
            values = values.groupBy(*t.by, "filled").agg(F.sum("c").alias("c"), F.max("one_raw").alias("one_raw"))
    joined = join_on(values.where("one_raw"), table_rows(t), t.by)
    return joined.where(F.col("c") == F.col("n_rows")).select(*t.by, "filled")


def all_not_eq(t: KeyedTable, col: str) -> DataFrame:
    """Values of the column that no row holds: there never is one, for an option is looked for among the cells."""
    return value_counts(t, col).where(F.col("cnt") == 0).select(*t.by, F.col("raw").alias("filled"))


def all_greater_eq(t: KeyedTable, col: str) -> DataFrame:
    """The minimum."""
    return col_min(t, col).select(*t.by, F.col("raw").alias("filled"))


def all_less_eq(t: KeyedTable, col: str) -> DataFrame:
    """The maximum."""
    return col_max(t, col).select(*t.by, F.col("raw").alias("filled"))


def all_greater(t: KeyedTable, col: str) -> DataFrame:
    """The round bound below the minimum."""
    joined = join_on(col_min(t, col), range_step(t, col), t.by)
    bound = floor_to(F.col("v").cast("double"), F.col("step"))
    return joined.select(*t.by, number_text(bound).alias("filled"))


def all_less(t: KeyedTable, col: str) -> DataFrame:
    """The round bound above the maximum."""
    joined = join_on(col_max(t, col), range_step(t, col), t.by)
    bound = ceil_to(F.col("v").cast("double"), F.col("step"))
    return joined.select(*t.by, number_text(bound).alias("filled"))

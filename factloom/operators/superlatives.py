"""Maximum, minimum and n-th values or rows of every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.keyed import KeyedTable
from factloom.operators.values import value_counts
from factloom.plans.ranking import running


def _extreme(t: KeyedTable, col: str, largest: bool) -> DataFrame:
    pick = F.max if largest else F.min
    if not t.has_raw(col):
        found = t.df.select(*t.by, t.value(col).alias("v")).groupBy(*t.by).agg(pick("v").alias("v"))
        found = found.where(F.col("v").isNotNull())
        return found.select(*t.by, "v", t.text_of_value(col, F.col("v")).alias("raw"))
    values = value_counts(t, col).where(F.col("v").isNotNull())
    best = values.groupBy(*t.by).agg(pick(F.struct("v", "raw")).alias("b"))
    return best.select(*t.by, F.col("b.v").alias("v"), F.col("b.raw").alias("raw"))


def col_max(t: KeyedTable, col: str) -> DataFrame:
    """(by, v, raw): the maximum and its original text; no row for a table of empty cells."""
    return _extreme(t, col, largest=True)


def col_min(t: KeyedTable, col: str) -> DataFrame:
    """(by, v, raw): the minimum and its original text; no row for a table of empty cells."""
    return _extreme(t, col, largest=False)


def _order_struct(t: KeyedTable) -> Column:
    return F.struct(*[F.col(o) for o in t.order])


def _extreme_row(t: KeyedTable, col: str, largest: bool) -> DataFrame:
    """First row with the extreme value.

    Partial aggregation leaves one row per table and map task, so a hot table is no concern. The
    value is found first and its first row second, each within one ordering.
    """
    rows = t.df.withColumn("__v", t.value(col)).where(F.col("__v").isNotNull())
    order = _order_struct(t)
    if largest and t.is_number(col):
        found = rows.groupBy(*t.by).agg(F.min_by(F.struct(*t.df.columns), F.struct(-F.col("__v"), order)).alias("r"))
    elif not largest:
        found = rows.groupBy(*t.by).agg(F.min_by(F.struct(*t.df.columns), F.struct("__v", order)).alias("r"))
    else:
        first = rows.groupBy(*t.by, "__v").agg(F.min_by(F.struct(*t.df.columns), order).alias("r"))
        found = first.groupBy(*t.by).agg(F.max_by("r", "__v").alias("r"))
    return found.select("r.*")


def col_argmax(t: KeyedTable, col: str) -> DataFrame:
    """The first row that holds the maximum."""
    return _extreme_row(t, col, largest=True)


def col_argmin(t: KeyedTable, col: str) -> DataFrame:
    """The first row that holds the minimum."""
    return _extreme_row(t, col, largest=False)


def _ranked(t: KeyedTable, col: str, largest: bool, keep: list[str]) -> DataFrame:
    """Rows of the upper (lower) half of a column with their rank ``nth``."""
    orders = [f"__o_{o}" for o in t.order]
    rows = t.df.select(
        *dict.fromkeys([*t.by, *keep]),
        *[F.col(o).alias(alias) for o, alias in zip(t.order, orders)],
        t.value(col).alias("__v"),
        t.text(col).alias("__raw"),
    )
    one = F.lit(1).cast("bigint")
    ranked = running(
        rows.where(F.col("__v").isNotNull()),
        t.by,
        ["__v", *orders],
        sums={"nth": one},
        totals={"__n": ("sum", one)},
        down=["__v"] if largest else [],
    )
    return ranked.where(F.col("nth") <= F.floor(F.col("__n") / 2))


def nth_max(t: KeyedTable, col: str) -> DataFrame:
    """(by, nth, raw): n-th largest cell, duplicates counted, for the larger half of the column."""
    return _ranked(t, col, True, []).select(*t.by, "nth", F.col("__raw").alias("raw"))


def nth_min(t: KeyedTable, col: str) -> DataFrame:
    """(by, nth, raw): n-th smallest cell, duplicates counted, for the smaller half."""
    return _ranked(t, col, False, []).select(*t.by, "nth", F.col("__raw").alias("raw"))


def nth_argmax(t: KeyedTable, col: str) -> DataFrame:
    """``nth`` and the whole row of the n-th largest cell; ties in row order."""
    return _ranked(t, col, True, t.df.columns).select(*t.df.columns, "nth")


def nth_argmin(t: KeyedTable, col: str) -> DataFrame:
    """``nth`` and the whole row of the n-th smallest cell; ties in row order."""
    return _ranked(t, col, False, t.df.columns).select(*t.df.columns, "nth")

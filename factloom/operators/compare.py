"""Scalars over options, and pairs of selected rows of one table.

A comparison of two rows of a table has as many true fillings as the table has pairs. They are kept
factorised: the selected rows of a table are ranked by the compared value, and every first row comes
with the range of ranks its second row may have and the number of those. ``expand_pairs`` writes the
pairs of chosen tables out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import round_two
from factloom.keyed import KeyedTable
from factloom.operators.selectors import filter_eq
from factloom.plans.ranking import join_on, running


def hop(rows: DataFrame, t: KeyedTable, col: str, raw: bool = False) -> DataFrame:
    """(by, out): the cell of ``col`` in one selected row per table, as text when it fills a hole."""
    out = t.text(col) if raw else t.value(col)
    return rows.select(*t.by, out.alias("out"))


def eq(a: Column, b: Column) -> Column:
    """Equality of two parts."""
    return a.eqNullSafe(b)


def not_eq(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def round_eq(value: Column) -> Column:
    """The literal of a rounded value."""
    return round_two(value)


def diff(a: Column, b: Column, timestamps: bool = False) -> Column:
    """Difference; whole days (rounded down) for timestamps."""
    if timestamps:
        micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
        return F.floor(micros / F.lit(86_400_000_000)).cast("double")
    return round_two(a.cast("double") - b.cast("double"))


def greater(a: Column, b: Column) -> Column:
    return a > b


def less(a: Column, b: Column) -> Column:
    return a < b


def logic_and(a: Column, b: Column) -> Column:
    return a & b


def single_rows(t: KeyedTable, filter_col: str, keep: list[str]) -> DataFrame:
    """(by, filled, keep): literals of ``filter_col`` that select exactly one row, with cells of that
    row. One aggregate: a group of one row is its own first row."""
    if t.is_string(filter_col) or t.has_raw(filter_col):
        chosen = filter_eq(t, filter_col, rows="one").select(*t.by, "filled")
        rows = t.df.select(*t.by, t.text(filter_col).alias("filled"), *keep)
        return join_on(rows, chosen, [*t.by, "filled"])
    grouped = (
        t.df.select(*t.by, t.value(filter_col).alias("__f"), *[F.col(c).alias(f"__k_{c}") for c in keep])
        .groupBy(*t.by, "__f")
        .agg(F.count(F.lit(1)).alias("__c"), *[F.min(f"__k_{c}").alias(c) for c in keep])
        .where(F.col("__c") == 1)
    )
    return grouped.select(*t.by, t.text_of_value(filter_col, F.col("__f")).alias("filled"), *keep)


def ranked_rows(t: KeyedTable, filter_col: str, hop_col: str) -> DataFrame:
    """Single rows ranked by the compared value: (by, filled, v, rank, below, upto, n).

    Equal values share ``below`` (rows with a smaller value) and ``upto`` (rows with at most it)."""
    rows = single_rows(t, filter_col, [hop_col]).withColumnRenamed(hop_col, "v").where(F.col("v").isNotNull())
    classes = running(
        rows.groupBy(*t.by, "v").agg(F.count(F.lit(1)).alias("c")),
        t.by,
        ["v"],
        sums={"upto": F.col("c")},
        totals={"n": ("sum", F.col("c"))},
    ).withColumn("below", F.col("upto") - F.col("c"))
    ranked = running(
        rows, t.by, ["v", "filled"],
        sums={"rank": F.lit(1).cast("bigint")}, totals={},
    )
    return join_on(ranked, classes.drop("c"), [*t.by, "v"])


def pairs(t: KeyedTable, func: str, filter_col: str, hop_col: str) -> DataFrame:
    """Fillings of ``func { hop { filter_eq { all_rows ; filter_col ; X } ; hop_col } ; hop { the same } }``.

    (by, first, v, rank, partner_from, partner_to, except_from, except_to, n_pairs): the second rows
    have ranks in ``partner_from..partner_to`` outside ``except_from..except_to``. Only first rows
    with a partner are kept, so a ``greater`` never starts at the minimum.
    """
    r = ranked_rows(t, filter_col, hop_col)
    none = F.lit(None).cast("bigint")
    one = F.lit(1).cast("bigint")
    below, upto, n, rank = F.col("below"), F.col("upto"), F.col("n"), F.col("rank")
    ranges = {
        "greater": (one, below, none, none, below),
        "less": (upto + 1, n, none, none, n - upto),
        "eq": (below + 1, upto, rank, rank, upto - below - 1),
        "not_eq": (one, n, below + 1, upto, n - (upto - below)),
        "diff": (one, n, below + 1, upto, n - (upto - below)),
    }[func]
    names = ["partner_from", "partner_to", "except_from", "except_to", "n_pairs"]
    found = r.select(
        *t.by, F.col("filled").alias("first"), "v", "rank", *[c.alias(x) for c, x in zip(ranges, names)]
    )
    return found.where(F.col("n_pairs") > 0)


def expand_pairs(found: DataFrame, ranked: DataFrame, by: list[str], tables: DataFrame) -> DataFrame:
    """(by, first, second) of the chosen ``tables``: the ranks of the partners are listed and looked
    up by equality. The output has ``n_pairs`` rows per first row; choose the tables by it."""
    inside = F.explode(F.sequence("partner_from", "partner_to")).alias("rank")
    chosen = join_on(found, tables.select(*by), by, "left_semi") if by else found
    listed = chosen.select(*by, "first", "except_from", "except_to", inside)
    wanted = listed.where(F.col("except_from").isNull() | ~F.col("rank").between(F.col("except_from"), F.col("except_to")))
    second = ranked.select(*by, "rank", F.col("filled").alias("second"))
    return join_on(wanted, second, [*by, "rank"]).select(*by, "first", "second")

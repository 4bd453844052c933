"""Joins and running totals per table that hold when one table has most of the rows."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges. The planner takes the size of files for that of their rows,
    but texts that repeat take many times the room in memory: broadcast, they fill the driver."""
    return df.hint("merge")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which an empty key matches an empty key; the left keys are kept.

    With no keys the right side must be one row (totals of one big table). Others are sorted and merged: see ``merged``.
    """
    if not keys:
        one = F.lit(1).alias("__one")
        return left.select("*", one).join(F.broadcast(right.select("*", one)), "__one", how).drop("__one")
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(merged(renamed), cond, how).drop(*[f"__{k}" for k in keys])


def _not_after(border: Column, row: Sequence[Column], names: Sequence[str], down: Collection[int]) -> Column:
    """Is a border the row's place or one before it? Empty values come first, or last where the order runs down."""
    out = F.lit(True)
    for i in reversed(range(len(names))):
        b, r = border[names[i]], row[i]
        before = (b > r) | (b.isNotNull() & r.isNull()) if i in down else (b < r) | (b.isNull() & r.isNotNull())
        out = F.coalesce(before, F.lit(False)) | (b.eqNullSafe(r) & out)
    return out


def _with_all_columns(df: DataFrame) -> DataFrame:
    """``df`` in which no use of it can leave out a column.

    Branches of a plan share a shuffle below them only if they ask for the same columns of it. The condition holds
    for every row, which the optimiser does not know.
    """
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) < 2)


def spread(df: DataFrame, keys: Sequence[Column], down: Collection[int] = (), name: str = "__part") -> DataFrame:
    """``df`` with the number of the stretch of the order that a row falls into, about as many rows in each.

    Borders are the places of least hash, as many as there are shuffle partitions: which rows they are depends on the
    keys alone, so a task that runs again, or another branch of a plan, finds the same numbers. ``keys`` tell all rows
    apart. A row's number comes from a binary search of the borders, a scalar subquery of that many keys.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    names = [f"k{i}" for i in range(len(keys))]
    places = df.select(*[k.alias(x) for k, x in zip(keys, names)])
    least = places.orderBy(F.xxhash64(*names), *names).limit(n - 1)
    ahead = lambda a, b: F.when(_not_after(b, [a[x] for x in names], names, down), F.lit(1)).otherwise(F.lit(-1))
    borders = least.agg(F.array_sort(F.collect_list(F.struct(*names)), ahead).alias("__borders"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((n - 1).bit_length()))])

    def search(borders: Column) -> Column:
        def step(at: Column, size: Column) -> Column:
            border = F.get(borders, at + size - 1)
            return F.when((at + size <= F.size(borders)) & _not_after(border, keys, names, down), at + size).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    # Named once, the borders go into the argument of ``transform``: one array for all rows. Named by a lambda's body or twice
    # they stay a column, and every row carries a copy of them, which costs rows times borders.
    told = df.select("*", borders.scalar().alias("__borders"))
    return told.select(*df.columns, F.get(F.transform(F.array("__borders"), search), F.lit(0)).alias(name))


def cumulated(df: DataFrame, by: Sequence[str], order: Sequence[str], out: Mapping[str, tuple[str, str, Column]], down: Collection[str] = (), part: Column | None = None) -> DataFrame:
    """``df`` with figures over the rows of a table that lie before, after or all around each row.

    ``order`` names columns that tell the rows of a table apart; those in ``down`` run downwards. ``out``: name ->
    (``sum``, ``min`` or ``max``; where; expression); where is ``upto`` (with the row itself), ``before``, ``after`` or
    ``all``. Where there are no rows a figure is empty. A table of any size is spread over many tasks: rows fall
    into stretches of the order (``spread``), each stretch of a table takes the figures of its own rows, windows over
    one row a stretch carry them on, and a row adds what its stretch is given to what lies inside it. Where the order
    itself names stretches of bounded size, ``part`` gives them, in order, and no borders are sought.
    """
    funcs = {"sum": F.sum, "min": F.min, "max": F.max}
    measured = _with_all_columns(df).select("*", *[c.alias(f"__m_{x}") for x, (_, _, c) in out.items()])
    places = [F.col(c) for c in [*by, *order]]
    rows = spread(measured, places, [i for i, c in enumerate([*by, *order]) if c in down]) if part is None else measured.withColumn("__part", part)
    # A stretch of a table as one value: it is never empty, and empty keys inside it are equal. So windows, sums and the join
    # below all take the rows as one shuffle deals them.
    others = [c for c in rows.columns if c not in by and c != "__part"]
    rows = rows.select(F.struct(*by, "__part").alias("__part"), *others).repartition("__part")
    # The sums read the same shuffle: they ask for all its columns.
    parts = rows.groupBy("__part").agg(F.max(F.xxhash64(*others)).alias("__all"), *[funcs[f](f"__m_{x}").alias(f"__s_{x}") for x, (f, _, _) in out.items()]).where("__all is not null")
    # What follows is summed up from the other end: a frame that ends with the last row is evaluated anew for every row.
    table, at = [F.col("__part")[c] for c in by], F.col("__part.__part")
    earlier = W.partitionBy(*table).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    frames = {"upto": earlier, "before": earlier, "after": W.partitionBy(*table).orderBy(at.desc()).rowsBetween(W.unboundedPreceding, -1), "all": W.partitionBy(*table)}
    given = parts.select("__part", *[funcs[f](f"__s_{x}").over(frames[where]).alias(f"__o_{x}") for x, (f, where, _) in out.items()])
    stretch = W.partitionBy("__part")
    key = lambda c: F.col("__part")[c] if c in by else F.col(c)
    inside, back = (stretch.orderBy(*[key(c).desc() if (c in down) == forth else key(c).asc() for c in order]) for forth in (True, False))
    near = {"upto": inside.rowsBetween(W.unboundedPreceding, 0), "before": inside.rowsBetween(W.unboundedPreceding, -1), "after": back.rowsBetween(W.unboundedPreceding, -1)}
    told = rows.select("*", *[funcs[f](f"__m_{x}").over(near[where]).alias(f"__h_{x}") for x, (f, where, _) in out.items() if where != "all"])

    def figure(x: str, f: str, where: str) -> Column:
        far = F.col(f"__o_{x}")
        if where == "all":
            return far
        here = F.col(f"__h_{x}")
        if f == "sum":
            return F.when(here.isNull(), far).when(far.isNull(), here).otherwise(here + far)
        return (F.least if f == "min" else F.greatest)(here, far)

    # So do the rows, with what only the sums look at: a condition over both sides stays at the join.
    joined = told.join(merged(given), "__part").where(F.pmod(F.xxhash64(*others, *[f"__o_{x}" for x in out]), F.lit(2)) < 2)
    return joined.select(*[key(c).alias(c) for c in df.columns], *[figure(x, f, where).alias(x) for x, (f, where, _) in out.items()])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], totals: Mapping[str, tuple[str, Column]], down: Collection[str] = ()) -> DataFrame:
    """Add inclusive running sums (in ``order``) and totals (``sum``, ``min`` or ``max``) per table: see ``cumulated``."""
    return cumulated(df, by, order, {x: ("sum", "upto", c) for x, c in sums.items()} | {x: (f, "all", c) for x, (f, c) in totals.items()}, down)

"""Balancing and sampling. Random choices follow a seeded hash of the row id, so they are the same on
every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import seeded_hash
from factloom.plans.ranking import join_on, running

DRAW_BLOCK = 100_000
MAX_OPTIONS = 5
RUNS = 10


def balanced_counts(rows: DataFrame, label: str, power: float = 0.5) -> DataFrame:
    """(label, count, balanced): class sizes in proportion to count ** power; the largest class keeps
    its size."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    largest = counts.agg(F.max("count").alias("largest"))
    size = F.pow("largest", F.lit(1 - power)) * F.pow("count", F.lit(power))
    return join_on(counts, largest, []).select(
        label, "count", F.floor(size + F.lit(1e-9)).cast("bigint").alias("balanced"))


def _draws(needs: DataFrame, label: str) -> DataFrame:
    """(label, need, pool, draw) with draw 1..need: whole blocks are spread before they are listed, so that
    a large class is not drawn by one task."""
    blocks = needs.select(
        label, "need", "pool",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / DRAW_BLOCK))).alias("block"),
    ).repartition(label, "block")
    first = F.col("block") * DRAW_BLOCK + 1
    last = F.least(F.col("need"), first + DRAW_BLOCK - 1)
    return blocks.select(label, "need", "pool", F.explode(F.sequence(first, last)).alias("draw"))


def oversample(rows: DataFrame, label: str, ids: list[str], pool: DataFrame | None = None, power: float = 0.5, seed: int = 42) -> DataFrame:
    """Rows to append so that the classes are balanced: (pool columns, draw).

    Without a ``pool`` the rows themselves are, and the pool always contains the rows as well, so by
    default every row is in it twice. A class that needs more rows than its pool holds is drawn with
    replacement, else without.
    """
    extra = rows if pool is None else pool
    source = rows.withColumn("__copy", F.lit(0)).unionByName(extra.withColumn("__copy", F.lit(1)))
    order = [*[F.col(i) for i in ids], F.col("__copy")]
    columns = source.columns
    ranked = running(
        source.withColumn("__h", seeded_hash(seed, *order)), [label], ["__h", *ids, "__copy"],
        sums={"__rank": F.lit(1).cast("bigint")}, totals={},
    )
    pools = source.groupBy(label).agg(F.count(F.lit(1)).alias("pool"))
    needs = (
        join_on(balanced_counts(rows, label, power), pools, [label])
        .select(label, "pool", (F.col("balanced") - F.col("count")).alias("need")).where(F.col("need") > 0)
    )
    draws = _draws(needs, label)
    digest = seeded_hash(seed, F.col(label), F.col("draw"))
    picked = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.col("pool") + 1
    chosen = draws.select(
        label, "draw", F.when(F.col("pool") < F.col("need"), picked).otherwise(F.col("draw")).alias("__rank"))
    return join_on(ranked.select(*columns, "__rank"), chosen, [label, "__rank"]).drop("__copy", "__rank")


def balance(rows: DataFrame, label: str, ids: list[str], pool: DataFrame | None = None, power: float = 0.5, seed: int = 42) -> DataFrame:
    """The rows and the oversampled ones."""
    added = oversample(rows, label, ids, pool, power, seed)
    return rows.unionByName(added.drop("draw"))


def select_outputs(preds: DataFrame, mode: str, ids: list[str], seed: int | Column = 42, by: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Predictions (by, grp, ids) chosen per group: ``all``, ``several`` (at most 5), ``single`` (one
    per group) or ``one`` (one per table).

    The rank limits run before the shuffle, so a hot group sends a few rows per task."""
    if mode not in ("all", "several", "single", "one"):
        raise ValueError(f"unknown selection mode {mode}")
    if mode == "all":
        return preds
    columns = preds.columns
    hashed = preds.withColumn("__h", seeded_hash(seed, *[F.col(i) for i in ids]))
    order = [F.col("__h"), *[F.col(i) for i in ids]]
    limit = MAX_OPTIONS if mode == "several" else 1
    kept = hashed.withColumn("__n", F.row_number().over(W.partitionBy(*by, "grp").orderBy(*order))).where(F.col("__n") <= limit)
    if mode == "one":
        kept = kept.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= 1)
    return kept.select(*columns)


def repeated_runs(preds: DataFrame, mode: str, ids: list[str], seed: int = 42) -> DataFrame:
    """The selections of all runs, with their ``run``: one for ``all``, else ten with seeds seed + run."""
    if mode == "all":
        return preds.withColumn("run", F.lit(0))
    # Rows come together before they are repeated: one shuffle of the rows, not of ten of each. A group
    # is read by one task, row by row: its memory does not grow with the group, its time does.
    near = preds.repartition(*[F.col(c) for c in (("table_id",) if mode == "one" else ("table_id", "grp"))])
    if mode in ("single", "one"):
        return _least_of_runs(near, ["table_id", "grp"] if mode == "single" else ["table_id"], ids, seed)
    repeated = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    return select_outputs(repeated, mode, ids, F.lit(seed) + F.col("run"), by=("run", "table_id"))


def _least_of_runs(preds: DataFrame, keys: list[str], ids: list[str], seed: int) -> DataFrame:
    """The row of least hash of each group in every run; the least of a table's groups is that of the table."""
    row = F.struct(*[F.col(c) for c in preds.columns])
    least = [F.min_by(row, F.struct(seeded_hash(seed + run, *[F.col(i) for i in ids]).alias("h"), *ids)) for run in range(RUNS)]
    found = preds.groupBy(*keys).agg(F.array(*least).alias("rows"))
    return found.select(F.posexplode("rows").alias("run", "row")).select("row.*", "run")


def summarise_runs(scores: DataFrame) -> DataFrame:
    """(metric, avg, std) over runs of (run, metric, score); the deviation is that of the population."""
    return scores.groupBy("metric").agg(F.avg("score").alias("avg"), F.stddev_pop("score").alias("std"))


def shuffle_predictions(preds: DataFrame, pos: str, text: str, seed: int = 42) -> DataFrame:
    """(pos, text) with the texts permuted: the row that is k-th by position gets the text that is k-th
    by hash. Both ranks are distributed prefix sums."""
    one = F.lit(1).cast("bigint")
    by_pos = running(preds.select(pos), [], [pos], sums={"k": one}, totals={})
    hashed = preds.select(F.col(pos).alias("__p"), text, seeded_hash(seed, F.col(pos)).alias("__h"))
    by_hash = running(hashed, [], ["__h", "__p"], sums={"k": one}, totals={})
    return by_pos.join(by_hash.select("k", text), "k").select(pos, text)

"""Plans of the statement operators: no pair of all rows, no Python."""

import random

import pytest
from pyspark.sql import functions as F

from factloom import KeyedTable
from factloom.operators import compare, majority, selectors, superlatives
from factloom.plans import ranking

OPERATORS = {
    "filter_eq": lambda t: selectors.filter_eq(t, "v"),
    "filter_greater_eq": lambda t: selectors.filter_greater_eq(t, "v"),
    "filter_greater": lambda t: selectors.filter_greater(t, "v"),
    "nth_max": lambda t: superlatives.nth_max(t, "v"),
    "most_greater": lambda t: majority.most_greater(t, "v"),
    "text": lambda t: selectors.filter_eq(t, "s"),
    "pairs": lambda t: compare.pairs(t, "greater", "i", "v"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_plan(spark, name):
    df = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("i"), (F.col("id") * 1.5).alias("v"), F.col("id").cast("string").alias("s"))
    plan = OPERATORS[name](KeyedTable(df, ["k"], ["i"]))._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["filter_greater_eq", "filter_greater", "nth_max", "most_greater", "pairs"])
def test_one_table_is_no_single_task(spark, name):
    """Rows of one big table never meet in one partition: what does is one row a stretch of the order."""
    df = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") * 1.5).alias("v"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = OPERATORS[name](KeyedTable(df, [], ["i"]))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before, "a job ran while the plan was built"
    # Windows over a whole table are over the sums of its stretches.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "__part" not in line and "__s_" not in line:
            raise AssertionError(line)
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        spread_rows = ranking.spread(df, [F.col("v"), F.col("i")]).groupBy("__part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
    assert len(spread_rows) == 8 and max(r["count"] for r in spread_rows) < 3000


@pytest.mark.parametrize("down", [(), ("v",), ("v", "i")])
def test_figures_equal_plain_ones(spark, down):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 1.0, 2.0, 5.5]), i, r.choice([None, 1, 7])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, v double, i int, x int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        wanted = {f"{f}_{w}": (f, w, F.col("x")) for f in ("sum", "min", "max") for w in ("upto", "before", "after", "all")}
        for by in (["k"], []):
            got = ranking.cumulated(df, by, ["v", "i"], wanted, down).collect()
            assert len(got) == len(rows)
            place = lambda row: tuple((0 if x is None else 1, x or 0) if c not in down else (1 if x is None else 0, -(x or 0)) for c, x in (("v", row[1]), ("i", row[2])))
            for g in got:
                mine = sorted((x for x in rows if not by or x[0] == g.k), key=place)
                at = [x[2] for x in mine].index(g.i)
                for name, (f, w, _) in wanted.items():
                    part = {"upto": mine[: at + 1], "before": mine[:at], "after": mine[at + 1 :], "all": mine}[w]
                    xs = [x[3] for x in part if x[3] is not None]
                    assert g[name] == ({"sum": sum, "min": min, "max": max}[f](xs) if xs else None), (name, by)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")

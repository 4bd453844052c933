"""Hand-computed results of the statement operators, in few and in many stretches of the order."""

import pytest
from pyspark.sql import functions as F

from factloom import KeyedTable
from factloom.functions import numbers as N
from factloom.operators import aggregates, compare, majority, ngrams, selectors, superlatives, universal, values


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["2", "9"])
def hand(spark, request):
    data = [(1, 1, 5.0), (1, 2, 5.0), (1, 3, 2.0), (1, 4, None), (1, 5, 9.0), (2, 1, None), (2, 2, None)]
    df = spark.createDataFrame(data, "k int, i int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield KeyedTable(df, ["k"], ["i"])
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_extremes(hand):
    assert rows(superlatives.col_max(hand, "v").select("k", "raw")) == [(1, "9")]
    assert rows(superlatives.col_min(hand, "v").select("k", "raw")) == [(1, "2")]
    assert rows(superlatives.col_argmax(hand, "v").select("i")) == [(5,)]
    assert rows(superlatives.col_argmin(hand, "v").select("i")) == [(3,)]


def test_nth(hand):
    assert rows(superlatives.nth_max(hand, "v")) == [(1, 1, "9"), (1, 2, "5")]
    assert rows(superlatives.nth_min(hand, "v")) == [(1, 1, "2"), (1, 2, "5")]
    assert rows(superlatives.nth_argmax(hand, "v").select("nth", "i")) == [(1, 5), (2, 1)]
    assert rows(superlatives.nth_argmin(hand, "v").select("nth", "i")) == [(1, 3), (2, 1)]


def test_aggregates(hand):
    assert rows(aggregates.col_sum(hand, "v")) == [(1, 21.0), (2, 0.0)]
    assert rows(aggregates.col_avg(hand, "v")) == [(1, 5.25)]
    assert rows(aggregates.count(hand)) == [(1, 5), (2, 2)]
    assert rows(aggregates.only(hand)) == [(1, False), (2, False)]


def test_selectors(hand):
    any_ = dict(rows="any")
    assert rows(selectors.filter_greater_eq(hand, "v", **any_)) == [(1, "2", 4), (1, "5", 3)]
    assert rows(selectors.filter_less_eq(hand, "v", **any_)) == [(1, "5", 3), (1, "9", 4)]
    assert rows(selectors.filter_eq(hand, "v", **any_)) == [(1, "", 1), (1, "2", 1), (1, "5", 2), (1, "9", 1), (2, "", 2)]
    assert rows(selectors.filter_eq(hand, "v")) == [(1, "5", 2), (2, "", 2)]
    assert rows(selectors.filter_eq(hand, "v", rows="one")) == [(1, "", 1), (1, "2", 1), (1, "9", 1)]
    assert rows(selectors.filter_not_eq(hand, "v", **any_)) == [
        (1, "", 4), (1, "2", 4), (1, "5", 3), (1, "9", 4), (2, "", 0)]
    # step 1: bounds 1, 4, 8 below and 3, 6, 10 above; bounds that keep all four values are left out
    assert rows(selectors.filter_greater(hand, "v", **any_)) == [(1, "4", 3), (1, "8", 1)]
    assert rows(selectors.filter_less(hand, "v", **any_)) == [(1, "3", 1), (1, "6", 3)]


def test_majority_and_universal(hand):
    assert rows(majority.most_greater_eq(hand, "v")) == [(1, "5")]
    assert rows(majority.most_less_eq(hand, "v")) == [(1, "5"), (1, "9")]
    assert rows(majority.most_less_eq(hand, "v", full_half=True)) == [(1, "5")]
    assert rows(majority.most_greater(hand, "v")) == [(1, "4")]
    assert rows(majority.most_less(hand, "v")) == [(1, "6")]
    assert rows(majority.most_eq(hand, "v")) == []
    assert rows(majority.most_not_eq(hand, "v")) == [(1, ""), (1, "2"), (1, "5"), (1, "9")]
    assert rows(universal.all_greater_eq(hand, "v")) == [(1, "2")]
    assert rows(universal.all_less_eq(hand, "v")) == [(1, "9")]
    assert rows(universal.all_greater(hand, "v")) == [(1, "1")]
    assert rows(universal.all_less(hand, "v")) == [(1, "10")]
    assert rows(universal.all_not_eq(hand, "v")) == []
    assert rows(universal.all_eq(hand, "v")) == [(2, "")]


def test_no_key_is_one_table(spark):
    df = spark.range(1, 101).select(F.col("id").alias("i"), (F.col("id") * 1.0).alias("v"))
    for shuffles in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        t = KeyedTable(df, [], ["i"])
        got = selectors.filter_greater(t, "v", rows="any")
        assert rows(got) == sorted((str(b), 100 - b) for b in range(10, 100, 10))
        assert superlatives.nth_max(t, "v").count() == 50
        assert rows(superlatives.nth_max(t, "v").where("nth = 3")) == [(3, "98")]
    spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.mark.parametrize("nums,step", [
    ([3, 7], 1), ([12, 45, 50], 5), ([60, 99], 10), ([100, 450], 50), ([900, 120], 100), ([3, 12], 5), ([-12, -45], 5)])
def test_step(spark, nums, step):
    t = KeyedTable(spark.createDataFrame([(float(n),) for n in nums], "v double").withColumn("k", F.lit(1)), ["k"])
    assert rows(values.range_step(t, "v").select("step")) == [(float(step),)]


def test_bounds_and_rounding(spark):
    df = spark.createDataFrame([(12.0,), (10.0,), (0.0,), (-5.0,)], "x double")
    got = {r.x: (r.f, r.c) for r in df.select("x", N.floor_to(F.col("x"), F.lit(5)).alias("f"), N.ceil_to(F.col("x"), F.lit(5)).alias("c")).collect()}
    assert got == {12.0: (10, 15), 10.0: (5, 15), 0.0: (0, 5), -5.0: (-10, 0)}
    assert spark.range(1).select(N.round_two(F.lit(0.575))).first()[0] == 0.57
    texts = spark.createDataFrame([(5.0,), (2.5,), (12345678.25,), (1e7,), (0.0001,)], "x double")
    assert [r[0] for r in texts.select(N.number_text(F.col("x"))).collect()] == ["5", "2.5", "12345678.25", "10000000", "0.0001"]


def test_ambiguous_texts_are_skipped(spark):
    df = spark.createDataFrame([(1, 1000.0, "1,000"), (1, 1000.0, "1000"), (1, 7.0, "7")], "k int, v double, r string")
    t = KeyedTable(df, ["k"], [], raw={"v": "r"})
    assert rows(selectors.filter_eq(t, "v", rows="any")) == [(1, "7", 1)]
    assert rows(superlatives.col_max(t, "v").select("raw")) == [("1,000",)]
    assert rows(majority.most_not_eq(t, "v")) == [(1, "7")]
    assert rows(values.raw_forms(t, "v")) == [(1, 7.0, "7", "7"), (1, 1000.0, "1,000", "1,000"), (1, 1000.0, "1000", "1,000")]


def brute_ngrams(texts):
    from collections import Counter, defaultdict
    from factloom.functions.text import STOP_WORDS
    occ, inn = Counter(), defaultdict(set)
    for s in texts:
        w = s.split(" ")
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                occ[n, " ".join(w[i:i + n])] += 1
                inn[n, " ".join(w[i:i + n])].add(s)
    keep = {g: c for g, c in occ.items() if c >= 3 and len(inn[g]) > 1
            and all(x.isalnum() for x in g[1].split(" ")) and not any(x in STOP_WORDS for x in g[1].split(" "))}
    return {g: c for g, c in keep.items()
            if not any(h[0] == g[0] + 1 and g[1] in h[1] and d == c for h, d in keep.items())}


TEXTS = ["red hot party time", "red hot part", "red hot", "red hot", "blue sea party time now", "party time", "art",
         "the red sea", "a b c d e", "x a b c d e y", "a b c d e f", "one two", "two one", "two one two", "-", "8 - 8"]


def test_ngrams_against_brute_force(spark):
    t = KeyedTable(spark.createDataFrame([(1, i, s) for i, s in enumerate(TEXTS)], "k int, i int, s string"), ["k"], ["i"])
    got = {(r.n, r.gram): r.freq for r in ngrams.frequent_ngrams(t, "s").collect()}
    assert got == brute_ngrams(TEXTS)
    giants = ["w" * 130 + " tail", "w" * 130 + " tail x", "w" * 130 + " tail y"]
    u = KeyedTable(spark.createDataFrame([(1, s) for s in giants], "k int, s string"), ["k"])
    assert {(r.n, r.gram): r.freq for r in ngrams.frequent_ngrams(u, "s").collect()} == brute_ngrams(giants)


def test_text_equality_is_token_containment(spark):
    import re
    t = KeyedTable(spark.createDataFrame([(1, i, s) for i, s in enumerate(TEXTS)], "k int, i int, s string"), ["k"], ["i"])
    wanted = set(TEXTS) | {g for _, g in brute_ngrams(TEXTS)}
    expect = {(1, c, sum(bool(re.search(f"(?:^| ){re.escape(c)}(?: |$)", s)) for s in TEXTS)) for c in wanted}
    assert set(rows(selectors.filter_eq(t, "s", rows="any"))) == expect
    assert rows(selectors.filter_not_eq(t, "s", rows="any").where("filled = 'red hot'")) == [(1, "red hot", 14)]


def test_text_majorities(spark):
    df = spark.createDataFrame([(1, "red hat"), (1, "red cap"), (1, "red shoe"), (1, "blue"), (2, "a"), (2, "a"), (2, "b"), (3, "z"), (3, "z"),
                                (4, "deep sea"), (4, "deep cave"), (4, "deep")], "k int, s string")
    t = KeyedTable(df, ["k"])
    assert rows(majority.most_eq(t, "s")) == [(1, "red"), (2, "a")]
    assert rows(universal.all_eq(t, "s")) == [(3, "z")]  # "deep" counts 3 as a gram and 1 as a value


def brute_pairs(data, func):
    from collections import Counter
    out = []
    for k in {d[0] for d in data}:
        seen = Counter(f for kk, f, _ in data if kk == k)
        single = [(f, v) for kk, f, v in data if kk == k and seen[f] == 1 and v is not None]
        test = {"greater": lambda a, b: a > b, "less": lambda a, b: a < b, "eq": lambda a, b: a == b,
                "not_eq": lambda a, b: a != b, "diff": lambda a, b: a != b}[func]
        out += [(k, str(f), str(g)) for f, v in single for g, w in single if f != g and test(v, w)]
    return sorted(out)


@pytest.mark.parametrize("func", ["greater", "less", "eq", "not_eq", "diff"])
def test_pairs_against_brute_force(spark, func):
    data = [(1, 1, 5.0), (1, 2, 5.0), (1, 3, 7.0), (1, 4, 1.0), (1, 4, 2.0), (1, 5, None), (1, 6, 7.0), (2, 1, 3.0), (2, 2, 4.0), (3, 1, 1.0)]
    t = KeyedTable(spark.createDataFrame(data, "k int, f int, v double"), ["k"], [])
    found = compare.pairs(t, func, "f", "v")
    ranked = compare.ranked_rows(t, "f", "v")
    expect = brute_pairs(data, func)
    assert rows(compare.expand_pairs(found, ranked, ["k"], t.df.select("k").distinct())) == expect
    assert sum(r.n_pairs for r in found.collect()) == len(expect)


def test_scalars(spark):
    df = spark.sql("select timestamp'2024-01-03 00:00:00' a, timestamp'2024-01-01 12:00:00' b, 3.456D x, 1.0D y, cast(null as double) z")
    got = df.select(
        compare.diff(F.col("a"), F.col("b"), timestamps=True), compare.diff(F.col("b"), F.col("a"), timestamps=True),
        compare.diff(F.col("x"), F.col("y")), compare.round_eq(F.col("x")), compare.not_eq(F.col("x"), F.col("z")),
        compare.greater(F.col("x"), F.col("y")), compare.less(F.col("x"), F.col("y")), compare.eq(F.col("x"), F.col("x")),
        compare.logic_and(F.col("x") > 1, F.col("y") > 1)).first()
    assert tuple(got) == (1.0, -2.0, 2.46, 3.46, True, True, False, True, False)

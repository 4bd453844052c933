"""Hand tables for cleaning, type inference, bounds of text jobs and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.operators import coltypes, corpus, metrics, sampling
from factloom.sources import readers


def cells(spark, table, header, rows):
    data = [(table, i + 1, j, header[j], v) for i, r in enumerate(rows) for j, v in enumerate(r)]
    return spark.createDataFrame(data, "table_id string, row_idx int, col_idx int, col_name string, raw string")


def test_clean(spark):
    dirty = cells(spark, "t", ["name", "score"], [["a", "1"], ["name", "score"], ["- ", "n/a"], ["t o t a l", "6"]])
    got = corpus.clean_cells(dirty).collect()
    assert sorted((r.row_idx, r.col_idx, r.raw, r.processed) for r in got) == [
        (1, 0, "a", "a"), (1, 1, "1", "1"), (3, 0, "- ", None), (3, 1, "n/a", None)]


TYPES = [
    (["july 4 , 1998", "may 5 , 1990"], "date", "date"), (["1875", "2003"], "season", "year"), (["1", "1", "2", "3"], "no", "rank"),
    (["3", "1", "7"], "wins", "num"), (["5", "5"], "wins", "num"), (["33:45", "12:10"], "clock", "time"),
    (["8 - 8", "6 - 10"], "record", "same_n_nums"), (["red", "blue"], "colour", "str"), (["red", "b2"], "code", "mixed"),
    (["-", ""], "any", "empty"), (["9", "3"], "rank now", "rank"), (["20 - 10 - 1", "5 - 2 - 3"], "record", "same_n_nums"),
]


def test_types(spark):
    parts = [cells(spark, str(i), [h], [[v] for v in vs]) for i, (vs, h, _) in enumerate(TYPES)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = {int(r.table_id): r.coltype for r in coltypes.infer_types(corpus.null_empty_cells(every)).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(TYPES)}


def test_variability_balance_accuracy(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "table_id string")
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("b", "y")], "table_id string, item string")
    assert metrics.variability(tables, items, "item").first()[0] == pytest.approx((1 + 0.5 + 1) / 3)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 16), ("b", 4), ("c", 1)) for i in range(n)], "k string, i int")
    assert {r.k: r.balanced for r in sampling.balanced_counts(rows, "k").collect()} == {"a": 16, "b": 8, "c": 4}
    judged = spark.createDataFrame([("a", "p", 1), ("a", "p", 1), ("a", "p", 1), ("a", "p", 0), ("b", "p", 0)], "table_id string, prediction string, label int")
    assert tuple(metrics.judged_accuracy(judged).first()) == (pytest.approx(0.6), pytest.approx(0.375))


def test_corpus_bleu(spark):
    preds = spark.createDataFrame([(1, "t", "the cat sat on the mat today")], "pred_id int, table_id string, text string")
    refs = spark.createDataFrame([("t", "the cat sat on the mat now")], "table_id string, text string")
    score = metrics.corpus_bleu(preds, refs).first()
    expect = 100 * math.exp(sum(math.log(x) for x in (6 / 7, 5 / 6, 4 / 5, 3 / 4)) / 4)
    assert (score.score, score.sys_len, score.ref_len) == (pytest.approx(expect), 7, 7)


def test_prediction_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join('{"out": ["s%d", "other"]}' % i for i in range(30)))
    got = readers.read_predictions(spark, str(path)).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(i, f"s{i}") for i in range(30)]

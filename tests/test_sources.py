"""Readers and writers on hand files: nothing is lost on the way."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import KeyedTable
from factloom.operators import metrics, ngrams
from factloom.operators.corpus import remove_leaks, replace_references
from factloom.operators.linearise import table_csv
from factloom.sources import readers, writers


@pytest.mark.parametrize("rows_per_part", [2, 100])
def test_csv_round_trip(spark, rows_per_part):
    rows = [("a", "1"), ('say "hi", ok', ""), ("two\nlines", "x,y"), ("", "4"), ("é", '"'), ("last", "6")]
    cells = [("t", i, j, name, value) for i, row in enumerate(rows, 1) for j, (name, value) in enumerate(zip(("n, a", "b"), row))]
    df = spark.createDataFrame(cells, "table_id string, row_idx int, col_idx int, col_name string, raw string")
    back = writers.read_table_csv(table_csv(df, rows_per_part), ["x", "y"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.x, r.y) for r in back] == [(i, *row) for i, row in enumerate(rows, 1)]


def test_labelled_statements_with_captions(spark, tmp_path):
    path = tmp_path / "statements.json"
    path.write_text(json.dumps({"t": [["a", "b c"], [1, 0], "caption"], "u": [["d"], [1]]}))
    got = readers.read_labelled_statements(spark, str(path)).orderBy("table_id", "pos").collect()
    assert [(r.table_id, r.pos, r.sentence, r.label) for r in got] == [("t", 0, "a", 1), ("t", 1, "b c", 0), ("u", 0, "d", 1)]


def test_objects_with_quotes_brackets_and_escapes(spark, tmp_path):
    texts = ['a "quoted" [text]', "back\\slash\\", '\\" ] , [', "{}", "", "é\n", '"']
    whole = {f'key "{i}" ]': [texts[: i + 1], list(range(i + 1)), 'x ", "y": [' * i] for i in range(7)}
    for name, indent in (("a", None), ("b", 1), ("c", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=name == "a"))
    (tmp_path / "d.json").write_text("{}\n")
    # Splits of a few bytes: every task begins inside of something.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.read_lines(spark, str(tmp_path), '"').rdd.getNumPartitions() > 20
        found = readers.read_entries(spark, str(tmp_path)).collect()
        said = readers.read_labelled_statements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in "abc":
        mine = sorted((x.entry, x.key, json.loads(x.value)) for x in found if x.file.endswith(f"{name}.json"))
        assert mine == [(i, k, v) for i, (k, v) in enumerate(whole.items(), 1)]
    assert sorted((r.table_id, r.pos, r.sentence, r.label) for r in said) == sorted((k, i, t, i) for k, v in whole.items() for i, t in enumerate(v[0]) for _ in "abc")


@pytest.mark.parametrize("text", ['{"a": [1, 2}', '{"a": "text"}', '[["a"], [1]]', '{"a": [[1]], "b"}', '{"a": [1]'])
def test_files_that_are_no_object_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        readers.read_entries(spark, str(tmp_path / "x.json")).collect()


def test_predictions_of_one_object(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"t": ["a", 'b "c"'], "u": [], "v": ["d"]}))
    got = readers.read_predictions(spark, str(tmp_path / "p.json")).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "a"), (1, 'b "c"'), (2, "d")]


def test_unmatched_forms_fail(spark):
    lines = [("f", 0, '    "url": "http://x/t1",'), ("f", 1, '    "logic_str": "eq"'), ("f", 2, '    "url": "http://x/t2",')]
    df = spark.createDataFrame(lines, "file string, line int, value string")
    assert [(r.table_id, r.lf) for r in readers.pair_generated(df.where("line < 2")).collect()] == [("t1", "eq")]
    for bad in (df, df.where("line > 0").where("line < 2")):
        with pytest.raises(Exception, match="differ in number"):
            readers.pair_generated(bad).collect()


def test_predictions_round_trip(spark, tmp_path):
    preds = spark.createDataFrame([(["x", "y"],), (["z"],)], "out array<string>").coalesce(1)
    writers.write_predictions(preds, str(tmp_path / "p.jsonl"))
    got = readers.read_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "x"), (1, "z")]


def test_unmatched_references_and_null_splits_stay(spark):
    refs = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "table_id string, pos int")
    said = spark.createDataFrame([("t", 1, "yes", 1), ("t", 2, "no", 0)], "table_id string, pos int, sentence string, label int")
    assert sorted((r.table_id, r.pos, r.ref) for r in replace_references(refs, said).collect()) == [("t", 1, "yes"), ("t", 2, None), ("u", 1, None)]
    rows = spark.createDataFrame([("a", "train"), ("b", None), ("c", "test")], "table_id string, split string")
    other = spark.createDataFrame([("a", "dev")], "table_id string, split string")
    assert sorted(r.table_id for r in remove_leaks(rows, other).collect()) == ["b", "c"]


def test_table_without_a_key_drops_explained_grams(spark):
    texts = ["red hot one", "red hot two", "red hot three"]
    df = spark.createDataFrame([(k, i, x) for k in (None, "t") for i, x in enumerate(texts)], "k string, i int, s string")
    got = ngrams.frequent_ngrams(KeyedTable(df, ["k"], ["i"]), "s").collect()
    assert sorted((r.k is None, r.gram) for r in got) == [(False, "red hot"), (True, "red hot")]


def test_long_grams_and_many_of_one_frequency(spark):
    long = "x" * 300 + "deep" + "y" * 200
    rows = [("k", f"{long} two three")] * 2 + [("k", f"{long} two other")]
    # A word inside the long token, as frequent as the gram; and one that is in no longer gram of its frequency.
    rows += [("k", "deep one"), ("k", "deep four"), ("k", "deep six"), ("k", "apart one"), ("k", "apart four"), ("k", "apart six"), ("k", "apart six")]
    df = spark.createDataFrame([(k, i, x) for i, (k, x) in enumerate(rows)], "k string, i int, s string")
    got = {r.gram for r in ngrams.frequent_ngrams(KeyedTable(df, ["k"], ["i"]), "s").collect()}
    assert f"{long} two" in got and long not in got and "two" not in got and "deep" not in got and "apart" in got


def test_explained_grams_by_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    grams = {(k, n, " ".join(word() for _ in range(n))): r.randint(3, 5) for _ in range(300) for n in (1, 2, 3) for k in "xy"}
    df = spark.createDataFrame([(k, n, g, f) for (k, n, g), f in grams.items()], "k string, n int, gram string, freq int")
    got = {(x.k, x.n, x.gram) for x in ngrams.drop_explained(["k"], df).collect()}
    inside = lambda k, n, g, f: any(k2 == k and n2 == n + 1 and f2 == f and g in g2 for (k2, n2, g2), f2 in grams.items())
    assert got == {(k, n, g) for (k, n, g), f in grams.items() if not inside(k, n, g, f)}


def test_many_grams_of_one_frequency(spark):
    grams = spark.range(50_000).select(F.lit("k").alias("k"), F.lit(1).alias("n"), F.concat(F.lit("w"), F.col("id")).alias("gram"), F.lit(3).alias("freq"))
    pairs = spark.range(0, 50_000, 2).select(F.lit("k").alias("k"), F.lit(2).alias("n"), F.concat(F.lit("w"), F.col("id"), F.lit(" z")).alias("gram"), F.lit(3).alias("freq"))
    left = ngrams.drop_explained(["k"], grams.unionByName(pairs)).where("n = 1")
    assert left.where("cast(substring(gram, 2) as int) % 2 = 0").count() == 0 and left.count() > 20_000


def test_containment_of_any_length(spark):
    texts = ["new york city hall", "old new york city hall tower", "new york city", "hall"]
    t = KeyedTable(spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("k", F.lit(1)), ["k"], ["i"])
    asked = spark.createDataFrame([(1, x) for x in [*texts, "york city"]], "k int, candidate string")
    counts = {r.candidate: r.n_rows for r in ngrams.containment_counts(t, "s", asked).collect()}
    assert counts == {texts[0]: 2, texts[1]: 1, texts[2]: 3, "hall": 3, "york city": 3}


def test_empty_references_are_none(spark):
    preds = spark.createDataFrame([(1, "a", "the cat sat on the mat"), (2, "b", "x")], "pred_id int, table_id string, text string")
    refs = spark.createDataFrame([("a", "the cat sat on the mat"), ("a", ""), ("b", "")], "table_id string, text string")
    row = metrics.corpus_bleu(preds, refs).first()
    assert row.score == pytest.approx(100) and (row.sys_len, row.ref_len) == (6, 6)

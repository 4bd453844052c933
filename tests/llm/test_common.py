"""Helpers over one row: running figures, spans, pieces; and texts with very many matches in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.llm import common, leaks, pii, rules, secret_scan


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4095, 4097, 300_000])
def test_scans_equal_plain_ones(spark, n):
    r = random.Random(n)
    values = [r.randint(-5, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = df.select(common.sums_before(F.col("v")), common.scanned(F.col("v"), F.greatest, F.lit(-9))).first()
    total, top = 0, -9
    for i, v in enumerate(values):
        assert (sums[i], tops[i]) == (total, top)
        total, top = total + v, max(top, v)
    assert len(sums) == len(tops) == n


def test_spans_gaps_and_stretches(spark):
    r = random.Random(2)
    texts = [None, "", "aaa", "b", *("".join(r.choice("ab😀\n ") for _ in range(r.randint(0, 300))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    text = F.coalesce("t", F.lit(""))
    cut = common.pieces(text, 16)
    got = df.select("i", common.match_spans(F.col("t"), "a+").alias("m"), common.gap_spans(F.col("t"), "a+").alias("g"), *[common.stretch(cut, 16, F.lit(at), F.lit(size)).alias(f"s{at}") for at, size in ((0, 16), (5, 16), (31, 3), (290, 9))]).collect()
    for x in got:
        t = texts[x.i] or ""
        assert [tuple(m) for m in x.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("a+", t)]
        ends = [0, *(m.end() for m in re.finditer("a+", t))]
        assert [tuple(g) for g in x.g] == ([(a, b) for a, b in zip(ends, re.split("a+", t))])
        for at, size in ((0, 16), (5, 16), (31, 3), (290, 9)):
            assert x[f"s{at}"] == t[at : at + size]


def _seconds(frame):
    began = time.time()
    rows = frame.collect()
    return rows, time.time() - began


def test_very_many_secrets_in_one_text(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "deadbeefdeadbeef01 " * n)], "doc_id long, text string")
    (row,), took = _seconds(secret_scan.find_secrets(docs).select(F.size("secrets").alias("n"), F.element_at("secrets", -1).alias("last")))
    assert row.n == n and row["last"].end == 19 * n - 1 and took < 20, took


def test_very_many_windows_of_high_entropy(spark):
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(r.choice(letters) for _ in range(40))
    n = 2_000
    docs = spark.createDataFrame([(1, f"{key} " * n), (2, "ab1 password=abcdefghijkl " * n)], "doc_id long, text string")
    rows, took = _seconds(secret_scan.find_secrets(docs).select("doc.doc_id", F.size("secrets").alias("n")))
    assert {x.doc_id: x.n for x in rows} == {1: n, 2: n} and took < 60, took


def test_very_many_identifiers_in_one_text(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "user@example.com 10.0.0.1 x, " * (n // 2)), (2, "call 555-0123-77 now; " * 20_000)], "doc_id long, text string")
    rows, took = _seconds(pii.find_pii(docs).select("doc.doc_id", F.size("entities").alias("n"), F.get("entities", F.lit(0)).alias("first")))
    assert {x.doc_id: x.n for x in rows} == {1: n, 2: 0} and took < 60, took


def test_a_million_words_of_one_phrase(spark):
    docs = spark.createDataFrame([(1, "a b c " * 333_334, "en", "s"), (2, " ".join(map(str, range(200_000))), "en", "s")], "doc_id long, text string, lang string, source string")
    rows, took = _seconds(rules.with_statistics(docs, ["doc_id"]).select("doc.doc_id", "n_words", "n_repeat_words", "base_failed"))
    assert {tuple(x) for x in rows} == {(1, 1_000_002, 1_000_002, True), (2, 200_000, 0, False)} and took < 20, took


def test_very_many_cuts_in_one_text(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "one two three four some other words here " * n)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    (row,), took = _seconds(leaks.decontaminated(docs, items))
    assert row.text == " some other words here " * n and took < 30, took

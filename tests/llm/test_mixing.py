"""Targets, epochs and samples of the mix."""

import random

import pytest

from factloom.llm import mixing


def brute_targets(sizes):
    """sizes: in source order. Shares by weight, capped, the excess reshared until none is above."""
    w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        left = total - sum(2 * sizes[i] for i in capped)
        ws = sum(w[i] for i in range(len(sizes)) if i not in capped)
        out = [2.0 * s if i in capped else left * w[i] / ws for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > 2 * sizes[i] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        source = r.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])
        n = r.choice([0, 1, 3, 10, 40])
        rows.append((i, r.choice([" ", "\n", "\t"]).join(["w"] * n) if n or r.random() < 0.5 else None, source, 1, 2))
    rows += [rows[5], rows[5], (None, "x y", "a", 1, 2), (None, "x y", "a", 1, 2), (9999, "", "empty", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, part int").repartition(5)
    got = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for d, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    taken = {}
    for x in got:
        assert x.source_size == sizes[x.doc.source] and x.target == pytest.approx(want[x.doc.source])
        assert x.taken in [k * x.size for k in range(3)]
        taken[x.doc.source] = taken.get(x.doc.source, 0) + x.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 20, (s, taken[s], want[s])
        epochs = {x.copies for x in got if x.doc.source == s}
        assert len(epochs) <= 2 and max(epochs) - min(epochs) <= 1 and max(epochs) <= 2
    again = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    assert sorted((str(x.doc.doc_id), x.size, x.taken) for x in got) == sorted((str(x.doc.doc_id), x.size, x.taken) for x in again)
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(x.copies for x in got)


def test_weights_raise_the_chance(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    heavy = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0), keep=["doc_id", "source"]).where("doc.source = 'b'").groupBy((F.col("doc.doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n"))
    n = {x.odd: x.n for x in heavy.collect()}
    assert n[0] + n[1] == 2000 or n[0] > n[1]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0

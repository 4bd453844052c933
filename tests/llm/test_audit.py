"""The filter audit against a document-by-document replay of every order."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import audit as A

DOCS = "doc_id long, text string, source string, good string, part string"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(rows):
    """Failed filters of each row, by the words of the contract."""
    import re

    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = [r for r in rows if (r[1] or "") == t and doc_id is not None and r[0] is not None and r[0] < doc_id]
        out.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(copies),
        })
    return out


def replay(rows, labels):
    flags = fails(rows)
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, flags) if (r[2] or "") == part]
        gone = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                hit = [x for x in left if x[1][name]]
                rest = [x for x in left if not x[1][name]]
                out[part, "".join(order), step] = [
                    len(rest), len(hit), sum(f[name] for _, f in mine) - len(hit), sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(r[0] in good for r, _ in hit), sum(r[0] in toxic for r, _ in hit), name,
                ]
                gone[name] = gone.get(name, 0) + len(hit)
                left = rest
        for key, x in out.items():
            if key[0] == part and len(x) == 7:
                x[6] = gone[x[6]]
    return out


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS)
    flagged = A.failures(docs, spark.createDataFrame(labels, LABELS))
    got = A.audit(flagged, A.FILTERS, F.col("source"), {"good": F.col("good"), "toxic": F.col("toxic")}).collect()
    assert len({(x.part, x.filter_order, x.step) for x in got}) == len(got)
    return {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.lost_good, x.lost_toxic, x.shapley] for x in got}


def sample(seed, n=60):
    r = random.Random(seed)
    texts = [None, "", " \n", "w " * 70, "LOUD " * 60, "a#b " + " ".join(map(str, range(80))), " ".join(map(str, range(55))), "x|y", "é " * 49, " "]
    rows = [(i if r.random() < 0.95 else None, r.choice(texts), r.choice(["s", "t", None, ""]), "g", "p") for i in range(n)]
    rows += rows[:5]
    r.shuffle(rows)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1]), "l") for i in range(0, n, 2)] + [(2, 1, 1, "l"), (None, 1, 1, "l")]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_replay(spark, seed):
    rows, labels = sample(seed)
    assert found(spark, rows, labels) == replay(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    got = found(spark, [(1, "one", "s", None, None)], [])
    assert len(got) == 600 and got["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_a_long_text(spark):
    rows = [(1, "word " * 400_000, "s", None, None), (2, " ".join(map(str, range(200_000))), "s", None, None)]
    got = found(spark, rows, [])
    assert got["s", "BACDE", 1][:2] == [1, 1] and got["s", "ABCDE", 1][:2] == [2, 0]


def test_removal_steps_are_the_least_places():
    orders = A.all_orders(5)
    masks = (np.arange(32)[:, None] >> np.arange(5)) & 1 == 1
    steps = A.removal_steps(masks, orders)
    for m in range(32):
        for o, order in enumerate(orders):
            assert steps[m, o] == next((s for s, f in enumerate(order, 1) if masks[m, f]), 6)
    assert A.scattered(steps, np.ones(32, dtype=np.int64), 5).sum(axis=1).tolist() == [31] * 120


def test_other_filters_and_orders(spark):
    docs = spark.createDataFrame([(1, 5, "x"), (2, 50, "x"), (3, 500, None)], "id int, n int, part string")
    flagged = docs.select("*", (F.col("n") < 100).alias("short"), (F.col("n") < 10).alias("tiny"))
    got = A.audit(flagged, ["short", "tiny"], F.col("part"), orders=[["tiny", "short"]]).collect()
    assert {(x.part, x.step, x.filter, x.kept, x.removed, x.redundant, x.unique_fails, x.shapley) for x in got} == {
        ("x", 1, "tiny", 1, 1, 0, 0, 1), ("x", 2, "short", 0, 1, 1, 1, 1), ("", 1, "tiny", 1, 0, 0, 0, 0), ("", 2, "short", 1, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        A.audit(flagged, ["short", "short"], F.col("part"))
    with pytest.raises(ValueError):
        A.audit(flagged, ["short", "tiny"], F.col("part"), orders=[["tiny"]])

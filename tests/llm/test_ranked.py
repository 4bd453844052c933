"""Ranked search against scores of every pair, and the dual tree against its own bounds."""

import random
import re

import numpy as np
import pytest

from factloom.llm import ranked as R

ITEMS = "item_id long, text string, rank string, score string"
DOCS = "doc_id long, text string, item string, n string"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(items, docs, k=10):
    import math

    sized = [(d[0], terms(d[1])) for d in docs]
    sized = [(d, t) for d, t in sized if t]
    n_docs, n_terms = len(sized), sum(len(t) for _, t in sized)
    out = []
    for item in {(i[0], i[1]) for i in items if i[1] is not None}:
        wanted = set(terms(item[1]))
        df = {t: sum(t in set(x) for _, x in sized) for t in wanted}
        scored = []
        for doc_id, have in sized:
            m = 100 - 90 + (90 * len(have) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * have.count(t)) // (1000 * have.count(t) + 8 * m)) for t in wanted if t in have)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item[0], at, None if none else d, -s) for at, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, items, docs, parts=4, **more):
    found = R.search(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS).repartition(parts), **more)
    return sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in found.collect()), key=str)


def sample(seed, n_docs=400, n_items=30):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Ünï", "a-b", "X1", "É"]
    text = lambda n: " ".join(words[min(len(words) - 1, int(r.paretovariate(0.6)))] for _ in range(n))
    docs = [(i, text(r.randint(0, 60)), None, None) for i in range(n_docs)]
    # A third of copies, repeated rows, and rows without an id or a text.
    docs += [(n_docs + i, docs[7][1], None, None) for i in range(n_docs // 2)] + docs[:5] + [(None, docs[3][1], None, None), (900_001, None, None, None), (900_002, " .-", None, None)]
    items = [(i, text(r.randint(1, 25)), None, None) for i in range(n_items)] + [(0, "other w3 text", None, None), (None, "w5 w6", None, None), (77, None, None, None), (78, "", None, None), (79, "neverseen", None, None)]
    return items + items[:2], docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "MOST_BATCH", 128)
    items, docs = sample(seed)
    assert got(spark, items, docs) == brute(items, docs)


def test_blocks_of_items_and_other_k(spark):
    items, docs = sample(5, 60, 12)
    assert got(spark, items, docs, k=3, block_bytes=300) == brute(items, docs, 3)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a", None, None)]) == [] and got(spark, [(1, "a", None, None)], []) == []
    assert got(spark, [(1, None, None, None)], [(1, None, None, None)]) == []


def test_a_long_text_in_pieces(spark, monkeypatch):
    raw = ("ab, CD! " * 3000 + "é" * 5000).encode()
    whole = R.term_counts(raw, {b"ab": 0, b"cd": 1, "é".encode() * 5000: 2})
    monkeypatch.setattr(R, "PIECE", 100)
    assert R.term_counts(raw, {b"ab": 0, b"cd": 1, "é".encode() * 5000: 2}) == whole == (6001, {0: 3000, 1: 3000, 2: 1})
    docs = [(1, "common " * 500_000 + "rare", None, None), (2, "rare words", None, None), (3, "common words", None, None)]
    items = [(1, "rare common", None, None)]
    assert got(spark, items, docs, 1) == brute(items, docs)


def test_pruning_leaves_pairs_out_and_loses_nothing():
    r = np.random.default_rng(3)
    weight = r.integers(1, 9000, 300)
    items = [np.unique(r.integers(0, 300, 12)) for _ in range(64)]
    x = np.zeros((1024, 300), dtype=np.float32)
    for d in range(1024):
        x[d, r.integers(0, 300, 5)] = r.integers(1, 50_000, 5)
    for i, item in enumerate(items):
        for copy in range(10):
            x[(37 * i + copy) % 1024, item] = 900_000
    tree = R.ItemTree(items, weight)
    best, docs = R.Best(tree, np.zeros(64, dtype=np.int64), 10), R.DocTree(x, weight)
    scored = R.dual_search(tree, best, docs, np.arange(1024), np.ones(1024, dtype=bool))
    leaves = sum(c is None for c in tree.children) * (docs.first_leaf + 1)
    assert scored < leaves
    # Once the best are known, a batch without better ones is left out.
    others = np.where(x > 50_000, 0, x).astype(np.float32)
    found = [s.copy() for s in best.scores]
    assert R.dual_search(tree, best, R.DocTree(others, weight), np.arange(1024) + 5000, np.ones(1024, dtype=bool)) < leaves / 20
    assert all((a == b).all() for a, b in zip(found, best.scores))
    q = np.zeros((64, 300), dtype=np.int64)
    for i, item in enumerate(items):
        q[i, item] = weight[item]
    scores = x.astype(np.int64) @ q.T
    for i in range(64):
        want = sorted((-s, d) for d, s in enumerate(scores[:, i]))[:10]
        assert [(-s, d) for s, d in zip(best.scores[i], best.ids[i])] == want
    for node, members in enumerate(tree.below):
        assert all(set(items[i]) <= set(tree.terms[node]) for i in members)
    for node in range(len(docs.begin)):
        assert np.array_equal(docs.most[node], docs.x[docs.begin[node] : docs.end[node]].max(axis=0))

"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import repeats


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    n = repeats.LENGTH
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        kept = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_anchor_is_the_leftmost_least_gram():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts, ends = np.array([0, 1000, 1300, 5000]), np.array([1000, 1300, 5000, 5000])
    which, low, high, a, core, upper = repeats.runs_of(data, starts, ends)
    covered = {}
    for w, lo, hi, at in zip(which, low, high, a):
        assert starts[w] <= lo <= hi and hi + repeats.LENGTH <= ends[w]
        assert hi <= at <= lo + repeats.LENGTH - repeats.GRAM
        for p in range(lo, hi + 1):
            covered[p] = at
    assert len(covered) == (1000 - 399) + (3700 - 399)
    # Equal windows have anchors at equal places.
    twice = np.concatenate([data[:1000], data[200:900]])
    out = repeats.runs_of(twice, np.array([0, 1000]), np.array([1000, 1700]))
    place = {}
    for w, lo, hi, at in zip(*out[:4]):
        for p in range(lo, hi + 1):
            place[w, p] = at - p
    assert all(place[1, 1000 + p] == place[0, 200 + p] for p in range(700 - 399))


def texts_with_repeats(seed):
    r = random.Random(seed)
    letters = "abcdefgh éü\n"
    prose = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [prose(r.choice([150, 390, 399, 400, 401, 520, 1400])) for _ in range(6)]
    out = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "ab" * 700, prose(3000)]
    for _ in range(25):
        out.append("".join(r.choice([prose(r.randint(0, 300)), r.choice(passages), r.choice(passages)[r.randint(0, 120) :], r.choice(passages)[: r.randint(100, 900)]]) for _ in range(r.randint(1, 6))))
    long = prose(2500)
    for _ in range(8):
        i, j = sorted((r.randrange(2500), r.randrange(2500)))
        out.append(long[:i] + r.choice(["", "x", "yz"]) + long[i:j] + r.choice(["", "q"]) + long[j:])
    return [*out, out[-1], out[-1], out[20], "a" * 398 + "b", "b" * 400]


@pytest.mark.parametrize("seed", range(3))
def test_documents(spark, seed):
    texts = texts_with_repeats(seed)
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)] + [(0, None, "r")], "doc_id long, text string, raw string").repartition(3)
    got = repeats.without_repeats(docs).collect()
    want = brute(texts)
    assert len(got) == len(texts) + 1
    for x in got:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc.doc_id], x.doc.doc_id
        assert sum(s.end - s.start for s in x.removed) == x.n_removed and x.doc.raw == "r"


def test_long_text_is_taken_in_parts(spark, monkeypatch):
    r = random.Random(5)
    block = "".join(r.choice("abcdefghij ") for _ in range(1500))
    text = "".join(r.choice("klmnopqrst ") for _ in range(repeats.CHUNK - 700)) + block + "".join(r.choice("klmnopqrst ") for _ in range(3000)) + block
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    x = repeats.without_repeats(docs).collect()[0]
    assert (x.n_removed, x.n_spans) == (3000, 2)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(docs).count() == 0
    lone = spark.createDataFrame([(1, "x" * 100), (2, None)], "doc_id long, text string")
    assert sorted((x.n_bytes, x.n_removed) for x in repeats.without_repeats(lone).collect()) == [(0, 0), (100, 0)]

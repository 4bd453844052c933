"""Fingerprints, anchors, links and groups against brute force."""

import random
import re

import numpy as np
import pytest

from factloom.llm import simhash
from factloom.llm.components import components


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def cluster(r, centres, n, most):
    out = []
    for _ in range(n):
        f = r.choice(centres)
        for _ in range(r.randint(0, most)):
            f ^= 1 << r.randrange(64)
        out.append(f)
    return out


def test_fingerprint():
    for text in [None, "", "a", "A b", "Ein Éin x\x0by", "a b c", "a b c a b c d", "wort " * 70000]:
        assert simhash.fingerprint(None if text is None else text.encode()) == (brute_fingerprint(text) if text is None or len(text) < 9999 else brute_fingerprint("wort wort wort"))


def test_anchors_meet_every_link():
    r = random.Random(3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(1, 3)):
            b ^= 1 << k
        who, slot = simhash.anchors(np.array([a, b], dtype="<u8"))
        asks = set((slot[(who == 0) & (slot & 1 == 0)] >> 1).tolist())
        assert asks & set((slot[who == 1] >> 1).tolist())
        homes = simhash.home_of(np.array([a], dtype=np.uint64))
        assert int(homes[0]) == int(slot[who == 0][0] >> 1)
        assert len(set(slot[who == 0].tolist())) == (who == 0).sum()


@pytest.mark.parametrize("crowd", [simhash.CROWD, 5])
def test_links_connect_what_brute_force_connects(spark, crowd):
    r = random.Random(crowd)
    fps = {*cluster(r, [0, (1 << 64) - 1, r.getrandbits(64)], 250, 9), *(r.getrandbits(64) for _ in range(100))}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    got = {x.node & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in components(simhash.links(df, crowd=crowd)).collect()}
    want = brute_groups(fps)
    by_got, by_want = {}, {}
    for f in fps:
        by_got.setdefault(got.get(f, f), set()).add(f)
        by_want.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_links_of_large_group_span_it():
    r = random.Random(5)
    fps = np.array(sorted({*cluster(r, [r.getrandbits(64)], 400, 2)}), dtype=np.uint64)
    a, b = simhash.links_in_groups(np.zeros(len(fps), dtype=np.int64), fps, np.zeros(len(fps), dtype=bool), 3)
    assert len(a) < len(fps)
    want = brute_groups(fps.tolist())
    assert len(set(want.values())) == len(fps) - len(a)


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(300, 300), (7, 7), (401, 400), (400, 401)]
    r.shuffle(chain)
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 100, 400: 400, 401: 400}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(400)]
    texts = [None, "", " \n", "Ab cd ef", "ab CD ef", "x", " ".join(base), " ".join([*base[:200], "new", *base[200:]]), " ".join(r.choice(words) for _ in range(300)), " ".join(r.choice(words) for _ in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, "nobody else has this text")]
    docs = spark.createDataFrame([(i, t, 5, "m") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = simhash.grouped(docs, keep=["doc_id", "fp"]).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    root = brute_groups(fps.values())
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fps[t]]] = min(least.get(root[fps[t]], i), i)
    want = sorted(((i, fps[t], least.get(root[fps[t]])) for i, t in rows), key=str)
    assert sorted(((x.doc.doc_id, x.fp & (1 << 64) - 1, x.least) for x in got), key=str) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    have = [x.doc_id for x in kept.collect()]
    assert len(have) == len(set(root.values())) and sorted(x for x in have if x is not None) == sorted(least.values())
    assert simhash.grouped(docs.limit(0)).count() == 0

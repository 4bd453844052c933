"""Decontamination against a search by brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import leaks
from factloom.llm.queries import leak_digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(text, items, window):
    w = words(text)
    hit, met = set(), set()
    for name, item in items:
        iw = words(item)
        size = min(window, len(iw))
        if not size:
            continue
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                met.add(name)
    return len(w), sorted(hit), met


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    letters = "abc"[: r.randint(1, 3)]
    window = r.choice([1, 2, 4])
    items = [(str(i), " ".join(r.choice(letters) for _ in range(r.randint(0, 9)))) for i in range(r.randint(0, 6))]
    machine = leaks.Automaton([(n, leaks.words_of(t.encode())) for n, t in items], window)
    for _ in range(30):
        text = " ".join(r.choice(letters + "x") for _ in range(r.randint(0, 20)))
        runs, met, _ = machine.scan(leaks.words_of(text.encode()))
        n, hit, want = brute(text, items, window)
        assert sorted(i for a, b in runs for i in range(a, b)) == hit
        assert met == want


def test_longest_match():
    machine = leaks.Automaton([("1", leaks.words_of(b"a b c d e"))], 3)
    assert machine.scan(leaks.words_of(b"x b c d y"))[2] == 3
    assert machine.scan(leaks.words_of(b"x y"))[2] == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_documents(spark, block_bytes):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (2, "second text of it"), (3, None), (4, "..."), (None, "nameless thing"), (10, "one two three four five six seven eight nine ten"), (2, "short item")]
    long = "ein ßwort " * 4000
    texts = [None, "", "nothing here", "x ONE two-three four five six seven eight nine ten; eleven twelve", "a short item, short item", "nameless thing", long, "short\x00item", "a short item, short item", "One Kelvin"]
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, leak int, raw string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")
    got = {r.doc_id: r for r in leak_digest(leaks.find_leaks(docs, bench, block_bytes=block_bytes)).collect()}
    for i, t in enumerate(texts):
        n, hit, met = brute(t, items, 10)
        names = sorted({str(x) for x in met if x is not None})
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, len(hit), len(names)), t
        assert got[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert got[i].contaminated == bool(hit)
    clean = {r.doc_id: r for r in leaks.decontaminated(docs, bench, most_covered=0.9).collect()}
    assert sorted(clean) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert clean[4].text == "a "
    assert clean[3].text == "x  twelve" and clean[6].text == long and clean[0].text is None and clean[3].leak == 3
    assert leaks.find_leaks(docs.limit(0), bench).count() == 0
    assert leaks.find_leaks(docs, bench.limit(0)).where(F.size("leak.runs") > 0).count() == 0

"""Licence scan against brute force over all passages and templates."""

import random
from collections import Counter

from factloom.llm import licences


def brute(text, least=licences.LEAST_DICE):
    """The best of all runs of words, wherever they begin and end."""
    words = licences.plain_words(text or "")
    pairs = list(zip(words, words[1:]))
    best = {}
    for name, template in licences.passages(licences.TEMPLATES):
        known = Counter(zip(template, template[1:]))
        n = sum(known.values())
        if sum((Counter(pairs) & known).values()) < least / (2 - least) * n - 1e-9:
            continue
        for i in range(len(pairs)):
            if pairs[i] not in known:
                continue
            left, shared = Counter(known), 0
            for size, p in enumerate(pairs[i : i + int((2 - least) / least * n + 1e-9)], 1):
                if left[p] > 0:
                    left[p] -= 1
                    shared += 1
                if 2 * shared >= least * (size + n) - 1e-12:
                    best[name] = max(best.get(name, 0), 2 * shared / (size + n))
    return sorted(best.items())


def test_scan(spark):
    r = random.Random(6)
    texts = [None, "", "nothing", "All rights reserved.", "x\nReleased  under the MIT license\ny", "Hello. Licensed under CC BY-NC 4.0. Bye", "ALL RIGHTS RESERVED all rights reserved", "word " * 30000 + "\nLicensed under the Apache License, Version 2.0.", "é licensed under the mit license é"]
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    for name, text in licences.TEMPLATES:
        texts.append(text)
        # Wrapped inside a longer paragraph, and as a comment right before code.
        texts.append("Some words of prose come first, and then\n" + wrap(text, "") + " And more words\nfollow without a break, " + "for a while " * 20)
        texts.append("/*\n" + wrap(text, " * ") + "\n */\nint main(void) { return run(argc, argv); }\n" + "x = x + 1\n" * 30)
        texts.append("Some prose here.\n\n" + text.replace(". ", ".\n") + "\n\nMore prose.")
        words = text.split(" ")
        for _ in range(4):
            changed = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 8))):
                k = r.randrange(len(changed))
                changed[k : k + r.randint(0, 1)] = r.choice([[], ["new"], ["the"], [words[r.randrange(len(words))]]])
            texts.append("intro\n" + " ".join(changed) + "\nend")
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[3], 1)], "doc_id long, text string, pair int").repartition(4)
    got = licences.scan(docs, keep=["doc_id", "pair"]).collect()
    assert len(got) == len(texts) + 2
    hits = 0
    for x in got:
        want = brute(texts[3 if x.doc.doc_id is None else x.doc.doc_id])
        assert [(y.licence, round(y.dice, 9)) for y in x.licences] == [(n, round(d, 9)) for n, d in want], x.doc
        hits += bool(want)
    assert hits > 60
    assert licences.scan(docs.limit(0)).count() == 0


def test_telling_words_are_in_every_match():
    for name, words in licences.passages(licences.TEMPLATES):
        telling = licences.telling_words(words)
        pairs = licences.bigrams(words)
        without = [p for p in pairs if not telling & set(p)]
        assert 2 * len(without) / (len(without) + len(pairs)) < licences.LEAST_DICE

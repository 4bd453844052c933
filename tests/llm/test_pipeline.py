"""The pipeline stage by stage over the small table, each stage against brute force on its own input."""

import zlib

import numpy as np
import pytest
from test_leaks import brute as brute_leaks
from test_mixing import brute_targets
from test_rules import brute as brute_statistics
from test_simhash import brute_fingerprint, brute_groups

import corpus_pipeline
from factloom.llm import rules, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows that each stage got and gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    folder = tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    for a, b in zip(out[:-2], out[1:-1]):
        assert a.columns == b.columns
    return [x.collect() for x in out]


def test_quality(spark, steps):
    judged = {x.doc.doc_id: x for x in rules.assess(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"]).collect()}
    kept = {x.doc_id for x in steps[1]}
    assert kept == {i for i, x in judged.items() if x.kept} and 0 < len(kept) < len(steps[0])
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for x in steps[0]:
        if brute_statistics(x.text)[-1]:
            assert x.doc_id not in kept
        elif labels.get(x.doc_id) == 1:
            assert x.doc_id in kept


def test_near_duplicates(steps):
    fps = {x.doc_id: brute_fingerprint(x.text) for x in steps[1]}
    root = brute_groups(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {x.doc_id for x in steps[2]} == set(least.values()) and len(steps[2]) == len(least)


def test_decontamination(spark, steps):
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = {x.doc_id: x for x in steps[3]}
    cut = 0
    for x in steps[2]:
        n, hit, _ = brute_leaks(x.text, items, 10)
        if len(hit) > 0.5 * n:
            assert x.doc_id not in after
        elif not hit:
            assert after[x.doc_id] == x
        else:
            cut += 1
            assert not brute_leaks(after[x.doc_id].text, items, 10)[1]
            assert brute_leaks(after[x.doc_id].text, [], 10)[0] == n - len(hit)
            assert after[x.doc_id].n_chars == len(after[x.doc_id].text)
    assert cut


def test_mix(steps):
    sizes, taken, largest = {}, {}, {}
    for x in steps[3]:
        n = brute_statistics(x.text)[0]
        sizes[x.source] = sizes.get(x.source, 0) + n
        largest[x.source] = max(largest.get(x.source, 0), n)
    for x in steps[4]:
        taken[x.source] = taken.get(x.source, 0) + brute_statistics(x.text)[0]
    order = sorted(sizes)
    for s, want in zip(order, brute_targets([sizes[s] for s in order])):
        # Whole documents: off by half of one at most.
        assert abs(taken[s] - want) <= largest[s] / 2


def test_tokens(steps):
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    at = 0
    want = []
    for x in sorted(steps[4], key=lambda x: (x.doc_id, x.text)):
        ids = [*encoder.encode(x.text, add_special_tokens=False).ids, 2]
        want.append((x.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(x) for x in steps[5]), key=lambda x: x[1]) == want

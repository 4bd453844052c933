"""Token files: exact ids, exact round trip, random access."""

import io
import random
import zlib

import numpy as np
import pytest

from factloom.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = tokens.pack(ids, bits)
        assert len(data) == 8 * -(-n * bits // 64)
        assert (tokens.unpack(data, n, bits) == ids).all()


def test_chunked_encoder_equals_the_tokenizer():
    enc = tokens.Encoder(PATH)
    r = random.Random(1)
    parts = ["a", "Word,", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", " ", "é", "漢字", "😀", "12", "3.5", "<|endoftext|>", "<|", "\x1c", " ", "x" * 40]
    for _ in range(1500):
        text = "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12)))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == want, repr(text)


def test_reader_reads_any_range():
    out = io.BytesIO()
    writer = tokens.TokenWriter(out, 17)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << 17, n).astype("<u4") for n in (0, 5, 3 * tokens.BLOCK + 7, 1, 20 * tokens.BLOCK, 9)]
    for i, ids in enumerate(docs):
        writer.add(i if i != 3 else None, ids)
    writer.close()
    reader = tokens.TokenReader(out)
    whole = np.concatenate(docs)
    assert reader.docs == [0, 1, 2, None, 4, 5] and reader.n_ids == len(whole)
    for i, ids in enumerate(docs):
        assert (reader.document(i) == ids).all()
    for a, b in [(0, 0), (3, 9), (tokens.BLOCK - 1, tokens.BLOCK + 1), (0, len(whole))]:
        assert (reader.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        tokens.TokenWriter(io.BytesIO(), 3).add(0, np.array([9], dtype="<u4"))


def test_files_hold_every_document_in_order(spark):
    rows = [(7, "seven seas"), (None, "no id"), (3, None), (3, "b"), (3, "b"), (1, ""), (9, "long " * 30000), (-4, "é\n\nü  x")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, part string")
    files, folder = tokens.write_tokens(docs, PATH, partitions=3)
    got = tokens.read_tokens(files, folder, with_ids=True).collect()
    enc = tokens.Encoder(PATH).tokenizer
    at = 0
    want = []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    # The same from files that end after a few ids or documents.
    for more in ({"file_ids": 4}, {"file_docs": 2}):
        files, folder = tokens.write_tokens(docs, PATH, partitions=2, **more)
        assert files.count() > 3 and files.agg({"n_docs": "sum"}).first()[0] == len(rows)
        assert sorted((tuple(r) for r in tokens.read_tokens(files, folder, with_ids=True).collect()), key=lambda r: r[1]) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files, folder = tokens.write_tokens(docs, PATH)
    assert tokens.read_tokens(files, folder).count() == 0

"""Token ids in files of fixed bit width.

A file holds the ids of consecutive documents, packed with the fewest bits that hold the largest id of the
vocabulary, in blocks of BLOCK ids. Layout, all integers little-endian:

    8 bytes   magic
    blocks    each BLOCK ids (the last one fewer), ``bits`` bits an id, lowest bit first, padded to 8 bytes
    index     doc ids (int64, with a byte each that tells null), first id of each document (uint64, one more at the
              end), offset of each block in the file (uint64, one more at the end)
    footer    bits, number of ids, number of documents, number of blocks, offset of the index (uint64 each), magic

Any range of ids is read by fetching its blocks alone and unpacking them with numpy.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import shared_folder, staged

MAGIC = b"FLTOKEN1"
BLOCK = 1 << 16
FOOTER = 5 * 8 + len(MAGIC)
# Ids and documents after which a writer begins another file: its index is held until the file ends.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
# An encoder forgets its known chunks beyond this many; results do not depend on it.
KNOWN = 1_000_000


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to whole 64-bit words."""
    n = len(ids)
    rows = -(-n // 64)
    lanes = np.zeros(rows * 64, dtype="<u8")
    lanes[:n] = ids
    lanes = lanes.reshape(rows, 64)
    out = np.zeros((rows, bits + 1), dtype="<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out[:, :bits].tobytes()[: 8 * -(-n * bits // 64)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` made, as unsigned 32-bit integers."""
    rows = -(-n // 64)
    words = np.zeros(rows * bits, dtype="<u8")
    got = np.frombuffer(data, dtype="<u8")
    words[: len(got)] = got
    words = words.reshape(rows, bits)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((rows, 64), dtype="<u4")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class Encoder:
    """Ids of texts, equal to those of the tokenizer over the whole text.

    A byte-level tokenizer of this family starts a new piece at each space behind a character that is no white
    space, so a text falls into chunks there; a chunk met before is looked up, the others go to the tokenizer.
    """

    _CUT = re.compile(r"(?<=\S) ")
    _INSIDE = re.compile(r"\s ")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # Marks that this tokenizer parts from the letters before them: a word is then encoded once for all of them.
        marks = ".,;:!?"
        alone = dict(zip(marks, self._whole(list(marks))))
        word, *marked = self._whole([" ab", *(" ab" + m for m in marks)])
        self.marks = {m: alone[m] for m, ids in zip(marks, marked) if ids == word + alone[m]}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self._CUT.split(text) if self._INSIDE.search(text) else text.split(" ")
        first = self._whole([parts[0]])[0] if parts[0] else b""
        del parts[0]
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > KNOWN:
                self.known.clear()
            gaps = [i for i, ids in enumerate(found) if ids is None]
            self._learn([parts[i] for i in gaps])
            for i in gaps:
                found[i] = self.known[parts[i]]
        return first + b"".join(found)

    def _learn(self, new: list[str]) -> None:
        known, marks = self.known, self.marks
        stems = {p: p[:-1] for p in new if p and p[-1] in marks and p[:-1].isalpha()}
        wanted = dict.fromkeys(stems.get(p, p) for p in new)
        known.update(self._chunks([p for p in wanted if p not in known]))
        known.update((p, known[stem] + marks[p[-1]]) for p, stem in stems.items())

    def _chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of `` chunk`` for each chunk, from one call over all of them in a row."""
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace() and "<|" not in p]
        out = dict(zip(odd := [p for p in new if p not in set(plain)], self._whole([" " + p for p in odd]))) if len(plain) < len(new) else {}
        if plain:
            e = self.tokenizer.encode(" " + " ".join(plain), add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            starts = np.fromiter((o[0] for o in e.offsets), dtype=np.int64, count=len(ids))
            sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) + 1
            cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]), "left").tolist()
            raw = ids.tobytes()
            out.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(plain, cuts, cuts[1:]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


class TokenWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.docs: list[int | None] = []
        self.starts, self.blocks = [0], []
        self.rest: list[np.ndarray] = []
        self.held = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id of document {doc_id} needs more than {self.bits} bits")
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, dtype="<u4")
        upto = len(ids) if last else len(ids) - len(ids) % BLOCK
        for a in range(0, upto, BLOCK):
            data = pack(ids[a : min(a + BLOCK, upto)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest, self.held = [ids[upto:].copy()], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + known.tobytes())
        self.out.write(np.array(self.starts, dtype="<u8").tobytes() + np.array([*self.blocks, self.at], dtype="<u8").tobytes())
        self.out.write(np.array([self.bits, self.starts[-1], len(self.docs), len(self.blocks), self.at], dtype="<u8").tobytes() + MAGIC)


class TokenReader:
    """Random access to one file. ``source`` is a file object that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - FOOTER)
        tail = source.read(FOOTER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.n_ids, n_docs, n_blocks, at = (int(x) for x in np.frombuffer(tail[: -len(MAGIC)], dtype="<u8"))
        source.seek(at)
        data = source.read(9 * n_docs + 8 * (n_docs + 1) + 8 * (n_blocks + 1))
        ids, known = np.frombuffer(data, dtype="<i8", count=n_docs), np.frombuffer(data, dtype=np.uint8, count=n_docs, offset=8 * n_docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        self.starts = np.frombuffer(data, dtype="<u8", count=n_docs + 1, offset=9 * n_docs).astype(np.int64)
        self.blocks = np.frombuffer(data, dtype="<u8", count=n_blocks + 1, offset=9 * n_docs + 8 * (n_docs + 1)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end`` of the file; only their blocks are read."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError((start, end))
        if start == end:
            return np.empty(0, dtype="<u4")
        first, last = start // BLOCK, (end - 1) // BLOCK
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.blocks[last + 1] - self.blocks[first]))
        # Whole blocks are whole words, so a run of blocks is one run of ids.
        n = min((last + 1) * BLOCK, self.n_ids) - first * BLOCK
        return unpack(data, n, self.bits)[start - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by a URI or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, vocabulary: int | None = None, end_id: int | None = 2, partitions: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> tuple[DataFrame, str]:
    """Encode every text and write the ids in ascending ``doc_id`` order; gives the files and their folder.

    docs: ``doc_id`` (integer) and ``text``; other columns are not read. Documents are dealt by ranges of
    ``doc_id`` and sorted inside a task, which writes a range as files of about ``file_ids`` ids and ``file_docs``
    documents at most, so files and what a task holds of them are bounded at every size; texts stream. A null text is an empty one, a
    null ``doc_id`` sorts first, rows with one ``doc_id`` are ordered by text, repeated rows stay. No documents: no
    files. Files: ``part`` and ``piece`` (their order), ``path`` (below the folder), ``n_ids``, ``n_docs``. Every
    attempt of a task writes under names of its own, and only the files of finished ones are named: nothing is renamed.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    if vocabulary is None:
        vocabulary = encoder(tokenizer).tokenizer.get_vocab_size()
    bits = bits_for(max(vocabulary, (end_id or 0) + 1))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = texts.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    numbered = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        files, root = place(folder)
        writer = out = None
        piece = 0

        def ended() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [name], "n_ids": pa.array([writer.starts[-1]], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64())})

        for batch in batches:
            for at, doc_id, text in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{at:06d}-{piece:06d}-{uuid.uuid4().hex}.tokens"
                    out = files.open_output_stream(f"{root}/{name}")
                    writer = TokenWriter(out, bits)
                ids = np.frombuffer(enc.encode(text.as_py()), dtype="<u4")
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.starts[-1] >= file_ids or len(writer.docs) >= file_docs:
                    yield ended()
                    writer, piece = None, piece + 1
        if writer is not None:
            yield ended()

    return staged(numbered.mapInArrow(write, "part int, piece int, path string, n_ids long, n_docs long"), "token-files"), folder


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """What the files say of each document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``, and on demand ``ids``.

    A task reads its file block by block; the counts of earlier files (one row a file) give the offsets.
    """
    # Files before one in its part, and parts before that one: a row a file, and one a part, whose number is a parameter.
    inside = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    based = files.join(parts, "part").select("part", "piece", "path", (F.col("earlier") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, root = place(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                with file_system.open_input_file(f"{root}/{path}") as source:
                    reader = TokenReader(source)
                    i, n = 0, len(reader.docs)
                    while i < n:
                        # As many documents as a few blocks hold, one at least.
                        j = max(i + 1, int(np.searchsorted(reader.starts, reader.starts[i] + 16 * BLOCK, "right")) - 1)
                        ids = reader.ids(int(reader.starts[i]), int(reader.starts[j]))
                        at = (reader.starts[i : j + 1] - reader.starts[i]).tolist()
                        raw = ids.tobytes()
                        out = {
                            "doc_id": pa.array(reader.docs[i:j], pa.int64()),
                            "start": pa.array(reader.starts[i:j] + base, pa.int64()),
                            "n_tokens": pa.array(np.diff(reader.starts[i : j + 1]), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(at, at[1:])], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(out)
                        i = j

    # Each file is one small row: dealt out again so that the files are read side by side.
    return based.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "piece").mapInArrow(read, schema)

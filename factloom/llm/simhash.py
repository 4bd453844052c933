"""Near-duplicates by 64-bit fingerprints and a covering code.

The code is a product of repetition codes: bits (0,1,2), (3,4,5), .. (60,61,62) by majority, bit 63 by itself. Its
covering radius is 21, one bit a block. A word's home is the codeword of its majorities. Two fingerprints that
differ in at most three bits have a word within one bit of the one and two bits of the other; so each fingerprint
goes to the homes of all words within two bits, asks at those within one bit, and every link is met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import staged
from factloom.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BLOCKS = 22
# Rows at an anchor that are compared with each other in memory; a fuller one is taken apart into single words.
CROWD = 20_000
# Pairs compared by one numpy call.
PAIRS = 2_000_000
_ONE = np.uint64(1)


def fingerprint(raw: bytes | None) -> int:
    """Majority of the bits of the hashes of all shingles; zero without words."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of each row as the struct ``doc`` with ``fp`` (the fingerprint as a signed long) and ``row_no``."""
    keep = docs.columns if keep is None else keep
    names = [docs[f"`{c}`"] for c in keep]
    schema = T.StructType([T.StructField("doc", docs.select(*names).schema), T.StructField("fp", T.LongType())])
    raw = docs.select(F.struct(*names).alias("doc"), docs["text"].cast("binary").alias("raw"))

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch["raw"]], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(fps)], ["doc", "fp"])

    return raw.mapInArrow(stamp, schema).withColumn("row_no", F.monotonically_increasing_id())


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint its anchors: index of the fingerprint, and ``2 * anchor + far``.

    ``far`` is 0 where a word within one bit is at home, 1 where it takes two bits.
    """
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    weight = np.empty((len(fps), BLOCKS), dtype=np.int8)
    weight[:, :-1] = bits[:, :63].reshape(len(fps), BLOCKS - 1, 3).sum(axis=2)
    weight[:, -1] = 3 * bits[:, 63]
    powers = np.int64(1) << np.arange(BLOCKS, dtype=np.int64)
    home = (weight >= 2) @ powers
    cheap = (weight == 1) | (weight == 2)
    cheap[:, -1] = True
    who, slot = [np.arange(len(fps))], [home * 2]
    for k in range(BLOCKS):
        near = np.flatnonzero(cheap[:, k])
        who.append(near)
        slot.append((home[near] ^ powers[k]) * 2)
        far = np.flatnonzero(~cheap[:, k])
        who.append(far)
        slot.append((home[far] ^ powers[k]) * 2 + 1)
        for j in range(k):
            both = np.flatnonzero(cheap[:, k] & cheap[:, j])
            who.append(both)
            slot.append((home[both] ^ powers[k] ^ powers[j]) * 2 + 1)
    return np.concatenate(who), np.concatenate(slot)


def home_of(words: np.ndarray) -> np.ndarray:
    """Anchors at which words are at home."""
    out = np.zeros(len(words), dtype=np.int64)
    for k in range(BLOCKS - 1):
        three = (words >> np.uint64(3 * k)) & np.uint64(7)
        out |= (np.bitwise_count(three) >= 2).astype(np.int64) << k
    return out | (words >> np.uint64(63)).astype(np.int64) << (BLOCKS - 1)


def words_around(fps: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words within two bits of fingerprints that are at home at ``anchor``: word, fingerprint, far."""
    singles = _ONE << np.arange(64, dtype=np.uint64)
    near = np.concatenate([np.zeros(1, dtype=np.uint64), singles])
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([near, singles[i] | singles[j]])
    words = fps[:, None] ^ flips[None, :]
    keep = home_of(words.reshape(-1)).reshape(words.shape) == anchor
    who, flip = np.nonzero(keep)
    return words[who, flip], fps[who], flip >= len(near)


class Forest:
    """Union of positions by links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            further = self.up[r]
            if (further == r).all():
                self.up[at] = r
                return r
            r = further

    def join(self, at: np.ndarray) -> None:
        r = np.unique(self.roots(at))
        self.up[r] = r[0]


def links_in_group(fps: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the askers of one group reach: as many as positions at most, not all pairs."""
    askers = np.flatnonzero(~far)
    forest = Forest(len(fps))
    step = max(1, PAIRS // len(fps))
    for a in range(0, len(askers), step):
        part = askers[a : a + step]
        close = np.bitwise_count(fps[part][:, None] ^ fps[None, :]) <= most
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            forest.join(np.flatnonzero(close[row]))
    at = np.arange(len(fps))
    root = forest.roots(at)
    moved = fps[root] != fps
    return fps[at[moved]], fps[root[moved]]


def links_in_groups(group: np.ndarray, fps: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group of rows sorted by group."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    askers = np.add.reduceat((~far).astype(np.int64), starts)
    out_a, out_b = [], []
    for g in np.flatnonzero((sizes > 64) & (askers > 0)):
        s = slice(starts[g], starts[g] + sizes[g])
        a, b = links_in_group(fps[s], far[s], most)
        out_a.append(a)
        out_b.append(b)
    # Small groups all at once: each asker next to each row of its group.
    size_at, start_at = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    rows = np.flatnonzero(~far & (size_at > 1) & (size_at <= 64))
    for i in range(0, len(rows), PAIRS // 64):
        part = rows[i : i + PAIRS // 64]
        n = size_at[part]
        left = np.repeat(part, n)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(start_at[part], n) + offset
        differ = np.bitwise_count(fps[left] ^ fps[right])
        hit = (differ <= most) & (differ > 0)
        out_a.append(fps[left[hit]])
        out_b.append(fps[right[hit]])
    if not out_a:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])


def _cut(kind: int, a: np.ndarray, b: np.ndarray, size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), size):
        yield _batch(kind, np.ascontiguousarray(a[i : i + size]), np.ascontiguousarray(b[i : i + size]))


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def compare_sorted(batches: Iterator[pa.RecordBatch], most: int, crowd: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``slot`` come in; out come links (kind 0) and the words of crowded anchors (kind 1 near, 2 far)."""
    slots = np.empty(0, dtype=np.int64)
    fps = np.empty(0, dtype=np.uint64)
    spilled: int | None = None
    rows = crowd or 2 * CROWD

    def scatter(anchor: int, group_fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(group_fps), 512):
            words, who, far = words_around(group_fps[i : i + 512], anchor)
            yield from _cut(1, words[~far], who[~far])
            yield from _cut(2, words[far], who[far])

    def settle(slots: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(slots):
            return
        group = slots >> 1
        if crowd is not None:
            values, counts = np.unique(group, return_counts=True)
            for anchor in values[counts > crowd]:
                yield from scatter(int(anchor), fps[group == anchor])
                keep = group != anchor
                slots, fps, group = slots[keep], fps[keep], group[keep]
            if not len(group):
                return
        a, b = links_in_groups(group, fps, (slots & 1).astype(bool), most)
        if len(a):
            yield from _cut(0, *_unique(a, b))

    for batch in batches:
        slots = np.concatenate([slots, batch["slot"].to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
        if spilled is not None:
            same = (slots >> 1) == spilled
            yield from scatter(spilled, fps[same])
            slots, fps = slots[~same], fps[~same]
            if len(slots):
                spilled = None
        if len(slots) > max(rows, 1 << 18):
            last = slots[-1] >> 1
            done = (slots >> 1) != last
            yield from settle(slots[done], fps[done])
            slots, fps = slots[~done], fps[~done]
            if crowd is not None and len(slots) > crowd:
                yield from scatter(int(last), fps)
                spilled, slots, fps = int(last), slots[:0], fps[:0]
    yield from settle(slots, fps)


def links(fps: DataFrame, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Links (``a`` > ``b``) that connect all fingerprints (column ``fp``, distinct) at ``most`` or fewer bits.

    ``most`` is three at most, for that is what the code's anchors cover. Within an anchor links span the rows
    that touch, so a group of copies gives about as many links as fingerprints. An anchor with more than
    ``crowd`` rows is taken apart by the finest code, every word an anchor of its own: at most 2,081 words a row.
    """
    if most > MOST_BITS:
        raise ValueError("the anchors cover three differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch["fp"].to_numpy(zero_copy_only=False)
            for i in range(0, len(whole), 4096):
                part = whole[i : i + 4096]
                who, slot = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(part[who])], ["slot", "fp"])

    # Few bytes a fingerprint become many rows: dealt out evenly before they do.
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    spread_out = dealt.mapInArrow(spread, "slot long, fp long")
    sorted_rows = spread_out.repartition(F.shiftright("slot", 1)).sortWithinPartitions("slot")
    found = staged(sorted_rows.mapInArrow(lambda b: compare_sorted(b, most, crowd), "kind byte, a long, b long"), "simhash-links")
    words = found.where("kind > 0").select(F.col("a").alias("word"), F.col("b").alias("fp"), (F.col("kind") == 2).alias("far"))
    # A word's rows are the fingerprints within two bits of it: 2,081 at most.
    fine = words.repartition("word").sortWithinPartitions("word").mapInArrow(lambda b: _compare_words(b, most), "kind byte, a long, b long")
    return found.where("kind = 0").unionByName(fine).select("a", "b").distinct()


def _compare_words(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    word, fps, far = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    for batch in batches:
        word = np.concatenate([word, batch["word"].to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
        far = np.concatenate([far, batch["far"].to_numpy(zero_copy_only=False)])
        if len(word) > 1 << 18:
            done = word != word[-1]
            if done.any():
                a, b = links_in_groups(word[done], fps[done], far[done], most)
                if len(a):
                    yield from _cut(0, *_unique(a, b))
            word, fps, far = word[~done], fps[~done], far[~done]
    if len(word):
        a, b = links_in_groups(word, fps, far, most)
        if len(a):
            yield from _cut(0, *_unique(a, b))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _groups(rows: DataFrame, most: int, crowd: int) -> DataFrame:
    """``fp``, ``root`` and ``least`` of every fingerprint of staged rows."""
    distinct = rows.groupBy("fp").agg(F.min("doc.doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), most, crowd), "simhash-stars")
    by_fp = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = by_fp.groupBy("root").agg(F.min("least").alias("least"))
    return staged(by_fp.select("fp", "root").join(of_root, "root"), "simhash-groups")


def grouped(docs: DataFrame, keep: Sequence[str] | None = None, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """The kept columns of each row as ``doc``, with ``fp``, ``root`` (its group) and ``least`` (smallest ``doc_id`` of the group).

    docs: ``doc_id`` (kept always) and ``text``, any other columns. Words are runs without blanks, A-Z
    lower-cased. A null or empty text has fingerprint zero and links like any other. Repeated rows share a
    group. A null ``doc_id`` is never the smallest; ``least`` is null where a group has no other.
    """
    rows = staged(with_fingerprints(docs, keep), "simhash-rows")
    return rows.join(_groups(rows, most, crowd), "fp")


def one_of_each(docs: DataFrame, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest ``doc_id`` (nulls last), the first such row."""
    rows = staged(with_fingerprints(docs), "simhash-rows")
    ids = rows.select("fp", F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.col("row_no")).alias("id"))
    # First per fingerprint, then per group: a group of copies never meets as rows.
    firsts = ids.groupBy("fp").agg(F.min("id").alias("id")).join(_groups(rows, most, crowd).select("fp", "root"), "fp")
    kept = firsts.groupBy("root").agg(F.min("id").alias("id")).select(F.col("id.row_no").alias("row_no"))
    return rows.join(kept, "row_no", "left_semi").select("doc.*")

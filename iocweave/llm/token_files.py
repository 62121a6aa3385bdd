"""Token-id files: Simple-8b word-aligned coding.

A file is a Parquet table of blocks in ascending document order, so that writing and reading go through Spark's
file systems and committers. A block's payload is self-contained, little-endian:

    "S8B1" | u32 documents | u64 ids | u64 words | u32 ids of each document |
    u64 ids before every 256th word | u64 words

A word has a 4-bit selector on top and 60 payload bits, first id lowest. Selectors 2 to 15 pack 60, 30, 20, 15, 12,
10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 or 60 bits; selectors 0 and 1 stand for
240 and 120 zeros. An id of more than 60 bits is escaped: a word of selector 0 with payload 1, then the id as a word of
its own. The last word may have unused places, which hold zeros; the number of ids tells.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iocweave.llm.common import starts_of
from iocweave.llm.encoder import encoder

# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
STRIDE = 256
MAGIC = b"S8B1"

BLOCK_SCHEMA = "part int, block int, first_doc long, n_docs int, n_ids long, doc_ids array<long>, payload binary"


ESCAPE = np.uint64(1)
_WIDTH = np.array([int(i).bit_length() for i in range(1 << 12)], np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, twelve at a time from the lowest."""
    width, rest, done = _WIDTH[ids & np.uint64(4095)], ids >> np.uint64(12), 12
    while rest.any():
        more = _WIDTH[rest & np.uint64(4095)]
        width = np.where(more > 0, more + np.int8(done), width)
        rest, done = rest >> np.uint64(12), done + 12
    return width


def _choose(width: np.ndarray) -> np.ndarray:
    """For each position the selector that takes most of the ids from there on; 15 where only one fits."""
    n, top = len(width), int(width.max())
    # Selectors as wide as the widest id fit everywhere; of these the first takes most.
    start = min(int(np.searchsorted(BITS, top)), 15)
    best = np.full(n, start, np.int8)
    # Grow a window and keep the selectors for which its widest id still fits.
    widest, k = width.copy(), 1
    for s in range(start - 1, -1, -1):
        want = int(COUNTS[s])
        while k < want:  # window maxima, doubling where possible
            step = min(k, want - k)
            if step < n:
                np.maximum(widest[:-step], widest[step:], out=widest[:-step])
            k += step
        fits = np.flatnonzero(widest <= BITS[s])
        if not len(fits):
            break
        best[fits] = s
    return best


def _heads(counts: np.ndarray) -> np.ndarray:
    """Where words begin, if one that begins at i takes ``counts[i]`` ids. Jumps are doubled four times, so that only
    every sixteenth word is found one after the other; the others follow from these all at once."""
    n = len(counts)
    jumps = [np.minimum(np.arange(n + 1) + np.append(counts, 0), n)]
    for _ in range(4):
        jumps.append(jumps[-1][jumps[-1]])
    far, found, at = jumps[4].tolist(), [], 0
    while at < n:
        found.append(at)
        at = far[at]
    heads = np.array(found)
    for jump in reversed(jumps[:4]):
        heads = np.stack([heads, jump[heads]], axis=1).ravel()
    return heads[heads < n]


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids: each word takes as many of the next ids as any selector can."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    best = _choose(_widths(ids))
    heads = _heads(COUNTS[best])
    chosen = best[heads]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in np.unique(chosen):
        if s < 2:
            continue
        rows = np.flatnonzero(chosen == s)
        first, packed = heads[rows], np.zeros(len(rows), np.uint64)
        for place in range(COUNTS[s]):
            packed |= padded[first + place] << np.uint64(place * BITS[s])
        words[rows] |= packed
    large = np.flatnonzero((chosen == 15) & (ids[heads] >> np.uint64(60) > 0))
    if len(large):
        words[large] = ESCAPE
        words = np.insert(words, large + 1, ids[heads[large]])
    return words


def _raw_words(words: np.ndarray) -> np.ndarray:
    """Where words stand that follow an escape. Such a word may look like an escape itself."""
    out, last = [], -2
    for at in np.flatnonzero(words == ESCAPE).tolist():
        if at != last + 1:
            out.append(at + 1)
            last = at
    return np.array(out, np.int64)


def _counts(words: np.ndarray) -> np.ndarray:
    """Ids that each word holds."""
    counts, raw = COUNTS[(words >> np.uint64(60)).astype(np.int64)], _raw_words(words)
    counts[raw - 1], counts[raw] = 0, 1
    return counts


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of Simple-8b words."""
    selector, raw = (words >> np.uint64(60)).astype(np.int64), _raw_words(words)
    selector[raw] = 0
    at = starts_of(_counts(words))
    out = np.zeros(max(int(at[-1]), n), np.uint64)
    for s in np.unique(selector):
        if s < 2:
            continue
        rows = np.flatnonzero(selector == s)
        first, taken, mask = at[rows], words[rows], np.uint64((1 << int(BITS[s])) - 1)
        for place in range(COUNTS[s]):
            out[first + place] = (taken >> np.uint64(place * BITS[s])) & mask
    out[at[raw]] = words[raw]
    return out[:n]


def write_block(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words = pack(ids)
    before = starts_of(_counts(words))[:-1][::STRIDE]
    return b"".join(
        [
            MAGIC,
            struct.pack("<IQQ", len(lengths), len(ids), len(words)),
            np.asarray(lengths, "<u4").tobytes(),
            before.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def read_block(payload: bytes, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids per document, and the ids from ``start`` to ``stop``; only the words that hold these are decoded."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids, n_words = struct.unpack_from("<IQQ", payload, 4)
    at = 24
    lengths = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    before = np.frombuffer(payload, "<u8", -(-n_words // STRIDE), at).astype(np.int64)
    at += 8 * len(before)
    words = np.frombuffer(payload, "<u8", n_words, at)
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return lengths, np.zeros(0, np.uint64)
    first = int(np.searchsorted(before, start, "right")) - 1
    last = int(np.searchsorted(before, stop, "left"))
    base = int(before[first])
    # A stride may begin with the word of an escape, which then stands before it.
    raw = set(_raw_words(words).tolist()) if ESCAPE in words else ()
    low, high = (k - (k in raw) for k in (first * STRIDE, min(last * STRIDE, n_words)))
    return lengths, unpack(words[low:high], stop - base)[start - base :]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents, end to end, with ``end_id`` after each; and where those of each start (and end)."""
    if end_id is None:
        return ids, starts
    moved = starts + np.arange(len(starts))
    out = np.empty(moved[-1], np.uint32)
    last = moved[1:] - 1
    out[last] = end_id
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside] = ids
    return out, moved


def _blocks(path: str, end_id: int | None, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names, lengths, kept, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(kept).astype(np.uint64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names[0]], pa.int64()),
                    pa.array([len(names)], pa.int32()), pa.array([len(ids)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())), pa.array([write_block(lengths, ids)], pa.binary()),
                ],
                ["part", "block", "first_doc", "n_docs", "n_ids", "doc_ids", "payload"],
            )

        for batch in batches:
            ids, starts = with_end(*encoder(path).encode_flat(batch.column(1)), end_id)
            ends, first = starts.tolist(), 0
            for i, name in enumerate(batch.column(0).to_pylist()):
                names.append(name)
                lengths.append(ends[i + 1] - ends[i])
                held += lengths[-1]
                if held >= block_ids:
                    kept.append(ids[ends[first] : ends[i + 1]])
                    yield flush()
                    names, lengths, kept, held, block, first = [], [], [], 0, block + 1, i + 1
            kept.append(ids[ends[first] :])
        if names:
            yield flush()

    return run


def encode_to_files(
    documents: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, block_ids: int = 1 << 16
) -> None:
    """Write the token ids of ``documents`` (doc_id, text) as a token-id table at ``path``, in ascending doc_id order.

    A null text counts as empty; ``end_id`` closes each document. Repeated rows are written as often as they occur;
    rows of equal doc_id stand together, in the order of their texts; a null doc_id comes first. Other columns are
    not read. A block is closed once it holds ``block_ids`` ids, and a document is never divided between blocks.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The range exchange carries texts: ids would have to be computed twice, once for its sample.
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, names, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lengths, ids = read_block(payload)
            ids = ids.astype(np.int64)
            at = starts_of(lengths)
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(start + at[:-1], pa.int64()), values], ["doc_id", "start", "ids"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _documents(batches):
        ids = batch.column("ids")
        at, flat = np.asarray(ids.offsets), np.asarray(ids.values)
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_files(spark, path: str, digests: bool = False) -> DataFrame:
    """Documents of a token-id table: (doc_id, start, ids), where start counts the ids of all documents before.

    With ``digests`` the columns n_tokens and ids_crc32 (of little-endian unsigned 32-bit ids) replace the ids. They
    are computed from the decoded ids, where these need not leave the task.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # Offsets in two steps: totals of the few written partitions in one window, blocks within each partition.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("offset"))
    starts = heads.join(parts, "part").select("part", "block", (F.col("base") + F.col("offset")).alias("start"))
    rows = blocks.join(starts, ["part", "block"]).select("start", "doc_ids", "payload")
    if digests:
        return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.mapInArrow(_documents, "doc_id long, start long, ids array<long>")

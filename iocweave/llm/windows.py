"""Repeated passages: Rabin-Karp hashes of every window of ``window`` words.

Each task looks at the windows of a batch of documents. Of equal windows in a batch only the least document can be
free of an earlier one, so one entry per window and batch goes on, and the others are marked at once; a window that
stands in a third of all documents sends as many entries as there are batches. Entries meet by hash in buckets, where
all but the least document are marked. Marks go back to their documents by parts of the corpus, and there overlapping
windows merge into maximal intervals, which are removed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import chunks, rows_of, starts_of, word_hashes, words_of

# Odd multipliers of the two polynomials, and the finaliser's.
BASE_KEY, BASE_BUCKET, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
#: A bucket keeps 56 bits of the key; which bucket it is adds more.
KEY_BITS = 56
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept_text string"
ENTRY_SCHEMA = "bucket long, part long, keys binary"


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit polynomial hashes of every window (across texts too; the caller knows the ends)."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        other = (words ^ (words >> np.uint64(29))) * np.uint64(MIX)
        for values, base in ((words, BASE_KEY), (other, BASE_BUCKET)):
            total = np.zeros(n, np.uint64)
            for j in range(window):
                total = total * np.uint64(base) + values[j : j + n]
            total ^= total >> np.uint64(31)
            total *= np.uint64(MIX)
            out.append(total ^ (total >> np.uint64(30)))
    return out[0] >> np.uint64(64 - KEY_BITS), out[1]


def _windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and bucket hash of every window of the texts."""
    counts, codes, words = words_of(texts)
    keys, spread = window_hashes(word_hashes(words)[codes], window)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = row[: len(keys)] == row[window - 1 :] if len(keys) else np.zeros(0, bool)
    return row[: len(keys)][whole], keys[whole], spread[whole]


def bucket_of(spread: np.ndarray, buckets: int) -> np.ndarray:
    return ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack_entries(docs: np.ndarray, keys: np.ndarray) -> bytes:
    """Entries in ascending order of doc_id: the distinct ids, how many keys each has, and the keys in 7 bytes."""
    ids, counts = np.unique(docs, return_counts=True)
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return b"".join(
        [struct.pack("<II", len(ids), len(keys)), ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), raw.tobytes()]
    )


def unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_ids, n = struct.unpack_from("<II", blob)
    ids = np.frombuffer(blob, "<i8", n_ids, 8)
    counts = np.frombuffer(blob, "<u4", n_ids, 8 + 8 * n_ids)
    raw = np.frombuffer(blob, np.uint8, 7 * n, 8 + 12 * n_ids).reshape(n, 7)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :7] = raw
    return np.repeat(ids, counts.astype(np.int64)), keys.view("<u8").ravel()


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part that Spark's ``pmod(xxhash64(doc_id), parts)`` gives."""
    ids, back = np.unique(docs, return_inverse=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(i.to_bytes(8, "little", signed=True), 42) for i in ids.tolist()), np.uint64, len(ids))
    return (hashes.view(np.int64) % parts)[back]


def _runs(labels: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal labels starts and ends."""
    if not len(labels):
        return []
    cuts = (np.flatnonzero(np.diff(labels)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(labels)], strict=True))


def _marks(docs: np.ndarray, keys: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Marked keys of the documents of each part."""
    part = part_of(docs, parts)
    by = np.lexsort((docs, part))
    docs, keys, part = docs[by], keys[by], part[by]
    runs = _runs(part)
    return [int(part[a]) for a, _ in runs], [pack_entries(docs[a:b], keys[a:b]) for a, b in runs]


def _scan(window: int, buckets: int, parts: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            texts = batch.column(1).take(pa.array(order))
            ids = ids[order]
            for part in chunks(texts, batch_bytes):
                row, key, spread = _windows(rows_of(texts, part), window)
                if not len(row):
                    continue
                docs = ids[part][row]
                # Stable, so the first of equal windows has the least doc_id.
                by = np.lexsort((spread, key))
                docs, key, spread = docs[by], key[by], spread[by]
                head = np.ones(len(key), bool)
                head[1:] = (key[1:] != key[:-1]) | (spread[1:] != spread[:-1])
                later = docs != docs[np.flatnonzero(head)][np.cumsum(head) - 1]
                bucket = bucket_of(spread, buckets)
                marked, blobs = _marks(docs[later], key[later], parts)
                out_bucket = [m % buckets for m in marked]
                out_part: list[int | None] = list(marked)
                docs, key, bucket = docs[head], key[head], bucket[head]
                by = np.lexsort((docs, bucket))
                docs, key, bucket = docs[by], key[by], bucket[by]
                for a, b in _runs(bucket):
                    out_bucket.append(int(bucket[a]))
                    out_part.append(None)
                    blobs.append(pack_entries(docs[a:b], key[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_bucket, pa.int64()), pa.array(out_part, pa.int64()), pa.array(blobs, pa.binary())],
                    ["bucket", "part", "keys"],
                )

    return run


def _meet(parts: int):
    def run(group: pa.Table) -> pa.Table:
        """Marks of a bucket: every entry whose window has one with a smaller doc_id. Marks made before pass through."""
        docs, keys, out_part, out_keys = [], [], [], []
        for part, blob in zip(group.column("part").to_pylist(), group.column("keys").to_pylist(), strict=True):
            if part is None:
                d, k = unpack_entries(blob)
                docs.append(d)
                keys.append(k)
            else:
                out_part.append(part)
                out_keys.append(blob)
        if docs:
            d, k = np.concatenate(docs), np.concatenate(keys)
            by = np.lexsort((d, k))
            d, k = d[by], k[by]
            head = np.ones(len(k), bool)
            head[1:] = k[1:] != k[:-1]
            later = d != d[np.flatnonzero(head)][np.cumsum(head) - 1]
            marked, blobs = _marks(d[later], k[later], parts)
            out_part += marked
            out_keys += blobs
        return pa.table({"part": pa.array(out_part, pa.int64()), "keys": pa.array(out_keys, pa.binary())})

    return run


def _remove(window: int):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(documents: pa.Table, marks: pa.Table) -> pa.Table:
        """The documents of a part without the words of their marked windows."""
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for blob in marks.column("keys").to_pylist():
            d, k = unpack_entries(blob)
            docs.append(d)
            keys.append(k)
        docs, keys = np.concatenate(docs), np.concatenate(keys)
        by = np.argsort(docs, kind="stable")
        docs, keys = docs[by], keys[by]
        ids = documents.column("doc_id").combine_chunks()
        texts = documents.column("text").combine_chunks()
        names = ids.to_pylist()
        out = {"n_words": [], "n_removed": [], "spans": [], "kept_text": []}
        done = 0
        for part in chunks(texts):
            counts, codes, words = words_of(rows_of(texts, part))
            spelled = words.cast(pa.binary()).to_pylist()
            hashes = word_hashes(words)
            at = starts_of(counts)
            for i, n in enumerate(counts.tolist()):
                own = codes[at[i] : at[i + 1]]
                spans = []
                name = names[done + i]
                a, b = (0, 0) if name is None else (np.searchsorted(docs, name, "left"), np.searchsorted(docs, name, "right"))
                if b > a and n >= window:
                    first = np.flatnonzero(np.isin(window_hashes(hashes[own], window)[0], keys[a:b]))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"start": int(a), "stop": int(b)} for a, b in turn.reshape(-1, 2)]
                    own = own[~gone]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(own))
                out["spans"].append(spans)
                out["kept_text"].append(b" ".join([spelled[c] for c in own.tolist()]).decode())
            done += len(counts)
        kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.string())
        return pa.table({"doc_id": ids} | {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    return run


def remove_repeats(
    documents: DataFrame, window: int = 13, bucket_chars: int = 16 << 20, batch_bytes: int = 8 << 20
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) for each row of ``documents`` (doc_id, text).

    Removed is each word covered by a window of ``window`` words that also starts in a document with a smaller doc_id,
    as the input stands. spans are the maximal intervals of removed words; kept_text joins the other words by a space.
    A null text has no words. Rows of equal doc_id do not count as earlier than each other. A null doc_id is neither
    smaller nor larger than any: its row loses nothing and takes nothing. Other columns are not read.
    ``bucket_chars`` of text share a bucket, and a part of the corpus; ``batch_bytes`` of text are looked at together.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    total = known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = parts = total // bucket_chars + 1
    entries = known.mapInArrow(_scan(window, buckets, parts, batch_bytes), ENTRY_SCHEMA)
    marks = entries.groupBy("bucket").applyInArrow(_meet(parts), "part long, keys binary")
    # A row without an id has no marks, and may be in any part.
    own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(parts)).cast("long")
    dealt = rows.withColumn("part", own).groupBy("part")
    return dealt.cogroup(marks.groupBy("part")).applyInArrow(_remove(window), RESULT)

"""Importance resampling towards a target: documents are weighed by hashed word features and drawn by Gumbel keys.

A document's counts of the buckets are kept as bit planes: plane i has the bit of a bucket set if bit i of its count is.
The gains of the buckets, in two's complement, are planes too. The weight, the sum of count times gain, is then a sum
over pairs of planes: the number of common bits times a power of two, exact in integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iocweave.llm.common import chunks, rows_of, starts_of, words_of, written

BUCKETS = 10_000
#: Words of a feature at most.
LONGEST = 3
#: Bytes of text whose features are held at once in a worker.
PIECE_BYTES = 1 << 20
#: Documents whose planes are held at once.
SIDE_BY_SIDE = 32

# Separators are x00-2F, x3A-60 and x7B-7F; A-Z become lower case before.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def feature_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of each text, A-Z lower-cased: counts, codes, distinct words."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(b"") if data is None else pa.py_buffer(_TABLE[np.frombuffer(data, np.uint8)])
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [texts.buffers()[0], offsets, data], offset=texts.offset)
    return words_of(spaced)


# Long words are rare; the crc32 of features with one is taken from the bytes.
_WIDEST = 64


@cache
def _zeros_after() -> np.ndarray:
    """For n = 0.._WIDEST, four tables that give the crc32 after n more zero bytes, by the bytes of the crc32 before."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of one step
    value = np.arange(256, dtype=np.uint32)
    tables = [np.stack([value << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_WIDEST):
        last = tables[-1]
        tables.append((last >> np.uint32(8)) ^ one[last & np.uint32(255)])
    return np.stack(tables).reshape(-1)


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    tables, base = _zeros_after(), by * 1024
    out = tables[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def feature_buckets(counts: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature and the text it belongs to. A feature is a run of 1 to LONGEST words, joined by a
    space; its bucket is its crc32 modulo BUCKETS. The crc32 of a run follows from those of its words."""
    raw = words.cast(pa.large_binary()).to_pylist()
    alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))[codes]
    after = np.fromiter((zlib.crc32(b" " + w) for w in raw), np.uint32, len(raw))[codes]
    size = np.fromiter(map(len, raw), np.int64, len(raw))[codes] + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(codes)) - np.repeat(starts_of(counts)[:-1], counts)
    long = size > _WIDEST
    by = np.where(long, 0, size)
    out, owners, crc = [alone % BUCKETS], [owner], alone
    for n in range(1, LONGEST):
        crc = np.concatenate([crc[:1], _shifted(crc[:-1], by[1:]) ^ after[1:]])
        for at in np.flatnonzero(long & (place >= n)):
            crc[at] = zlib.crc32(b" ".join(raw[c] for c in codes[at - n : at + 1]))
        full = place >= n
        out.append(crc[full] % BUCKETS)
        owners.append(owner[full])
    return np.concatenate(out), np.concatenate(owners)


def _segments(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of a long text, in segments of about PIECE_BYTES. A segment begins with the last words of the
    one before, whose own features are left out."""
    spaced, at, tail = text.translate(_TABLE.tobytes()), 0, []
    while at < len(spaced):
        stop = spaced.find(b" ", at + PIECE_BYTES)
        stop = len(spaced) if stop < 0 else stop
        segment = pa.array([(b" ".join(tail) + b" " + spaced[at:stop]).decode()], pa.large_string())
        counts, codes, words = words_of(segment)
        buckets, _ = feature_buckets(counts, codes, words)
        counted = np.bincount(buckets, minlength=BUCKETS)
        if tail:
            head, _ = feature_buckets(np.array([len(tail)]), codes[: len(tail)], words)
            counted -= np.bincount(head, minlength=BUCKETS)
        yield int(counts[0]) - len(tail), counted
        tail = words.cast(pa.large_binary()).take(pa.array(codes[-(LONGEST - 1) :])).to_pylist()
        at = stop


def _pieces(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with words per row, and buckets with their row in the range: features of about PIECE_BYTES of text at
    once. A longer text is a range of its own and comes several times, each time with some of its words."""
    for part in chunks(texts, PIECE_BYTES):
        rows = rows_of(texts, part)
        if len(rows) == 1 and rows[0].is_valid and rows[0].as_buffer().size > 2 * PIECE_BYTES:
            for n, counted in _segments(rows[0].as_buffer().to_pybytes()):
                buckets = np.repeat(np.arange(BUCKETS), counted)
                yield part, np.array([n], np.int64), buckets, np.zeros(len(buckets), np.int64)
        else:
            counts, codes, words = feature_words(rows)
            yield part, counts, *feature_buckets(counts, codes, words)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, buckets, _ in _pieces(batch.column(0)):
            total += np.bincount(buckets, minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket: BUCKETS numbers, whatever the input."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_totals, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio)) of the smoothed shares of each bucket in the target and in the corpus."""
    s, t = float(corpus.sum()), float(target.sum())
    ratio = [((b + 1.0) * (s + BUCKETS)) / ((a + 1.0) * (t + BUCKETS)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of integers (two's complement): row, plane, 64-bit words."""
    rows, n = values.shape
    padded = np.zeros((rows, bits, -(-n // 64) * 64), bool)
    for k in range(bits):
        padded[:, k, :n] = (values >> k) & 1
    return np.packbits(padded, axis=-1).view(np.uint64)


class Weigher:
    """Weights of documents under fixed gains."""

    def __init__(self, gain: np.ndarray):
        self.bits = max(int(np.abs(gain).max(initial=0)).bit_length(), 1) + 1
        self.gain = planes(gain[None, :], self.bits)[0]
        self.power = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        self.power[-1] *= -1  # the sign

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """The sum of count times gain for each row of counts."""
        bits = max(int(counts.max(initial=0)).bit_length(), 1)
        own = planes(counts, bits)
        out = np.zeros(len(counts), np.int64)
        for i in range(bits):
            common = np.bitwise_count(own[:, i, None, :] & self.gain[None, :, :]).sum(axis=-1, dtype=np.int64)
            out += (common @ self.power) << np.int64(i)
        return out


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(gain)
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for part, counts, buckets, owner in _pieces(batch.column(1)):
                words[part] += counts
                at = starts_of(np.bincount(owner, minlength=part.stop - part.start))
                order = np.argsort(owner, kind="stable")
                flat, whose = buckets[order], owner[order]
                for first in range(0, part.stop - part.start, SIDE_BY_SIDE):
                    last = min(first + SIDE_BY_SIDE, part.stop - part.start)
                    of = slice(at[first], at[last])
                    key = (whose[of] - first) * BUCKETS + flat[of]
                    held = np.bincount(key, minlength=(last - first) * BUCKETS).reshape(last - first, BUCKETS)
                    weight[part.start + first : part.start + last] += weigh(held)
            features = sum(np.maximum(words - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document under the ``gain`` of each bucket."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")


def gumbel_key(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight + floor(1000 times a Gumbel draw), the draw from a hash of seed and doc_id. The largest keys of a set are
    a weighted sample without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rank`` 1, 2, 3 ... of the first ``most`` rows in ``order``, null for the others.

    Rows are dealt by ranges; the driver sees one number for each range. Only ranges that begin among the first
    ``most`` rows are numbered within.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, at = [], 0
    for part, n in sorted(ranged.groupBy("_range").count().collect()):
        before.append((part, at, n))
        at += n
    first = [(part, at) for part, at, _ in before if at < most]
    null = F.lit(None).cast("long").alias("rank")
    if not first:
        return ranged.select(*rows.columns, null)
    starts = rows.sparkSession.createDataFrame(first, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    drawn = ranged.join(F.broadcast(starts), "_range").withColumn("_n", F.col("_before") + within)
    drawn = drawn.select(*rows.columns, F.when(F.col("_n") <= most, F.col("_n")).cast("long").alias("rank"))
    return drawn.unionByName(ranged.filter(F.col("_range") > first[-1][0]).select(*rows.columns, null))


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Weigh ``documents`` (doc_id, text) by their likeness to ``target`` (text) and draw ``percent`` of them.

    Returns for every row doc_id, n_words, n_features, weight, score and rank: of the N documents with at least
    ``min_words`` words the floor(percent N / 100) of largest score are drawn and numbered from 1, ties by smaller doc_id
    (then by fewer features, smaller weight); rank is null for the others. A null text has no words, a text without words weight 0, a
    null doc_id hashes as nothing and is the smallest. Repeated rows are drawn each on their own. Empty tables give
    no rows, or the weights under no target. Other columns are not read.
    """
    gain = gains(bucket_totals(documents), bucket_totals(target))
    rows = weigh(documents, gain).withColumn("score", gumbel_key(F.col("weight"), F.col("doc_id"), seed).cast("long"))
    rows = written(rows, "weights")
    can = rows.filter(F.col("n_words") >= min_words)
    drawn = numbered(can, [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], percent * can.count() // 100)
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)

"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of ``radius + 1`` bits. For every nonzero vector v there is a table that
keeps the bits whose vectors have an odd product with v. The differing bits of a pair within the radius are at most
``radius`` vectors, so some v has an even product with all of them, and the pair falls into one bucket of its table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import chunks, rows_of, same_columns, starts_of, words_of, written
from iocweave.llm.components import components
from iocweave.operators.match import skew_join

SEED = 42
BITS = 64


def masks(radius: int) -> list[int]:
    """A mask of kept bits for each table."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, n + 1)]


def blocks(mask: int, radius: int) -> list[int]:
    """The bits outside a mask in ``radius + 1`` parts; a pair of the same bucket within the radius agrees in one."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers: a bit is set if it is set in over half of the shingle hashes."""
    digest = xxhash.xxh64_intdigest
    out = []
    for part in chunks(texts, 2 << 20):
        counts, codes, words = words_of(rows_of(texts, part), lower=True)
        spelled = words.cast(pa.binary()).to_pylist()
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        ends = starts_of(counts)
        result = np.zeros(len(counts), np.uint64)
        for i, n in enumerate(counts.tolist()):
            if not n:
                continue
            own = codes[ends[i] : ends[i + 1]]
            text = b" ".join([spelled[c] for c in own.tolist()])
            at = starts_of(size[own] + 1)
            k = min(shingle, n)
            cuts = zip(at[: n - k + 1].tolist(), (at[k:] - 1).tolist(), strict=True)
            hashes = np.fromiter((digest(text[a:b], SEED) for a, b in cuts), np.uint64, n - k + 1)
            total = np.zeros(BITS, np.int64)
            for a in range(0, len(hashes), 1 << 16):
                rows = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            result[i] = np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]
        out.append(result)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text as a long with the same bits; a text without words, or null, has 0."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(texts, shingle).view(np.int64), pa.int64())

    return run(text)


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """The least value reachable from each of the distinct values by steps within the radius.

    Values found leave the rest that later steps look at, so a dense group costs about its size and not its square.
    """
    n = len(values)
    root = np.arange(n)
    order = np.argsort(values.view(np.int64), kind="stable")
    rest = order
    while len(rest):
        seed, rest = rest[0], rest[1:]
        root[seed] = seed
        queue = [seed]
        while queue and len(rest):
            near = np.bitwise_count(values[rest] ^ values[queue.pop()]) <= radius
            if near.any():
                found = rest[near]
                root[found] = seed
                queue.extend(found.tolist())
                rest = rest[~near]
    return root


def _edges(radius: int):
    """Links of each bucket as a star around its least member; the rows of a bucket stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> tuple[np.ndarray, np.ndarray]:
            values = np.unique(np.concatenate(held))
            root = linked(values, radius)
            off = root != np.arange(len(values))
            return values[root[off]].view(np.int64), values[off].view(np.int64)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            values = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(values):
                continue
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges_a, edges_b = [], []
            bounds = [0, *cuts.tolist(), len(values)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                key = tuple(keys[:, a].tolist())
                if key != held_key:
                    if sum(map(len, held)) > 1:
                        x, y = close()
                        edges_a.append(x)
                        edges_b.append(y)
                    held_key, held = key, []
                held.append(values[a:b])
            if edges_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(edges_a), pa.int64()), pa.array(np.concatenate(edges_b), pa.int64())], ["a", "b"]
                )
        if sum(map(len, held)) > 1:
            x, y = close()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def near_classes(values: DataFrame, radius: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """(fp, root) for the distinct ``values`` (fp long) that link to another one at ``radius`` or fewer differing bits.

    A bucket with more than ``bucket_rows`` values is divided again by each part of the bits that its table leaves out;
    a pair within the radius agrees in one of the parts, so no link is lost.
    """
    tables = masks(radius)
    keys = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(tables)]
    )
    rows = values.select("fp", F.inline(keys))
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    rows = skew_join(rows, large, ["t", "key"], "left")
    parts = F.array(*[F.array(*[F.lit(signed(b)) for b in blocks(m, radius)]) for m in tables])
    inside = F.transform(F.get(parts, F.col("t")), lambda b: F.col("fp").bitwiseAND(b))
    whole = F.array(F.lit(0).cast("long"))
    rows = rows.select("t", "key", F.posexplode(F.when(F.col("n").isNull(), whole).otherwise(inside)).alias("part", "own"), "fp")
    rows = rows.repartition("t", "key", "part", "own").sortWithinPartitions("t", "key", "part", "own")
    return components(rows.mapInArrow(_edges(radius), "a long, b long"))


def _marked(documents: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row."""
    text = F.col("text").cast("string")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprint(text, shingle).alias("fp")
    )
    rows = written(rows, "fingerprints")
    # Equal fingerprints are one class, however many rows have them.
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = near_classes(classes.select("fp"), radius)
    named = skew_join(classes, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(skew_join(named, least, ["root"]).select("fp", "root", "component_id"), "named")
    return skew_join(rows, named, ["fp"])


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents`` (doc_id, text).

    fingerprint has 16 lowercase hex digits; component_id is the least doc_id reachable by links of at most ``radius``
    differing bits, the row's own included. A null text counts as empty, and empty texts have fingerprint 0, linked
    like any other. Repeated rows come back as often as they occur; a row with a null doc_id links like the others,
    and a component of null ids only has a null component_id. Other columns are not read.
    """
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _marked(documents, shingle, radius).select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one row of each near-duplicate group: of its least doc_id, and if several rows have that id,
    the text with the least hash.

    All columns are kept. Of repeated rows one stays. A row with a null doc_id stays only if its whole group has none.
    """
    best = _marked(documents, shingle, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    absent, known = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    keys = ["__llm_id", "__llm_absent", "__llm_hash"]
    best = best.groupBy("root", known.alias("__llm_id"), absent.alias("__llm_absent")).agg(F.min("text_hash").alias("__llm_hash"))
    own = dict(zip(keys, (known, absent, F.xxhash64(F.col("text").cast("string"))), strict=True))
    rows = documents.withColumns(own).join(best, keys, "left_semi").dropDuplicates(keys)
    return rows.select(*same_columns(documents))

"""What the operators share: session settings, tables in the shared folder, words of Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave.session import tune, work_dir

#: Python tasks take their rows in batches of at most so many bytes, whatever the length of the texts.
BATCH_BYTES = 8 << 20


#: A Bloom filter has at most 8 MB whatever it is made from, so it may be used for tables of any size.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and readable after executors are lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: pa.Array, most_bytes: int = BATCH_BYTES) -> Iterator[slice]:
    """Row ranges of about ``most_bytes`` of text each (a longer text is a range of its own)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most_bytes:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def same_columns(documents: DataFrame, **changed: Column) -> list[Column]:
    """All columns of ``documents`` in order, some of them replaced. Internal names start with ``__llm_``, so columns
    of any other name pass unharmed."""
    return [changed[c].alias(c) if c in changed else F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]


def rows_of(texts: pa.Array, part: slice) -> pa.Array:
    """A copy of some rows: not every Arrow function reads a slice from its own start."""
    return texts.take(pa.array(np.arange(part.start, part.stop)))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: their number per text, a code for each, and the distinct words by code.

    A null text has no words. ``lower`` lower-cases A-Z only.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    # An empty piece stands before or after white space at an end of the text.
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = np.asarray(split.offsets)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    counts = before[offsets[1:]] - before[offsets[:-1]]
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    return counts.astype(np.int64), np.asarray(encoded.indices).astype(np.int64), encoded.dictionary


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each of the consecutive runs starts, and the total at the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def gather(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit values of ``parts[c]`` for each code, end to end, and where those of each code start (and end)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat, first = np.frombuffer(b"".join(parts), "<u4"), starts_of(size)
    at = starts_of(size[codes])
    spots = np.arange(at[-1]) + np.repeat(first[codes] - at[:-1], size[codes])
    return flat[spots], at

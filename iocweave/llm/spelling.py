"""Spelling variants: words one edit apart, found by Gram matrices of letter counts, and the commoner form of each.

Words are described by how often each letter occurs in them. One edit moves a word by a squared distance of 1 (a letter
more or less) or 2 (a letter replaced), so a matrix product of two blocks of words gives all pairs that can be one edit
apart, and only these are compared letter by letter.

Which blocks must meet follows from coarser counts. The letters are dealt to ``CLASSES`` classes; a *cell* holds the
words with the same number of letters of each class, hence of one length. One edit takes a letter from at most one class
and gives one to at most one, so a cell meets itself, the cells with a letter moved from one class to another, and those
a letter shorter: all other pairs of cells hold no near words. A large cell is cut into blocks of ``BLOCK_WORDS`` words,
and every pair of blocks of two meeting cells is a row of its own, so no cell is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import starts_of, written
from iocweave.operators.match import skew_join

#: Classes of letters. Frequent letters are dealt over the classes in turn; any other code point goes by its number.
CLASSES = 6
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
#: Words of a block, and its code points at most (a longer word is a block of its own).
BLOCK_WORDS, BLOCK_POINTS = 1024, 1 << 20
#: Up to this length all sums of the product are exact in single precision.
SINGLE = 1500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int) -> Column:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``least`` letters; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([A-Za-zÀ-ÿ]{{{int(least)},}})"), F.lit(1))


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are. ``lower`` does that for plain ASCII, and faster."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted_words(documents: DataFrame, min_length: int = 7, min_count: int = 2, slip: int | None = 31) -> DataFrame:
    """(word, n): the distinct words of ``documents`` (doc_id, text) and how often each occurs.

    Words are runs of letters, A-Z lower-cased. With ``slip`` an occurrence loses a letter if ``slip`` divides h, the
    crc32 of ``<doc_id>:<word>``: the one at h modulo its length. Words of fewer than ``min_length`` letters (afterwards)
    or ``min_count`` occurrences go. A null text has no words, a null doc_id is written as nothing, repeated rows count
    each, an empty table gives no rows; other columns are not read.
    """
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(runs(F.col("text").cast("string"), min_length)).alias("_run"),
    ).select("_id", lowered(F.col("_run")).alias("word"))
    if slip is not None:
        h, size = F.col("_h"), F.length("word")
        at = (h % size).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size.cast("int")))
        rows = rows.select("word", F.crc32(F.concat("_id", F.lit(":"), "word")).alias("_h"))
        rows = rows.select(F.when(h % slip == 0, cut).otherwise(F.col("word")).alias("word"))
        rows = rows.filter(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words, end to end, and the length of each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


def _class_of() -> np.ndarray:
    table = np.arange(256) % CLASSES
    for i, letter in enumerate(FREQUENT):
        table[ord(letter)] = i % CLASSES if i // CLASSES % 2 == 0 else CLASSES - 1 - i % CLASSES
    return table


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cell of each word: its letters of each class."""
    table = _class_of()
    for batch in batches:
        points, sizes = _points(batch.column(0).to_pylist())
        kind = np.where(points < 256, table[np.minimum(points, 255)], points % CLASSES)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(owner * CLASSES + kind, minlength=len(sizes) * CLASSES).astype(np.int32)
        cell = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * CLASSES), pa.array(counts))
        yield pa.RecordBatch.from_arrays([*batch.columns, cell], ["word", "n", "cell"])


def _meeting() -> Column:
    """The cells that a cell meets: itself, one letter moved to a later class, one letter less."""
    cell = F.col("cell")
    out = [cell]
    for i in range(CLASSES):
        for j in [*range(i + 1, CLASSES), None]:
            moved = [cell[k] + (int(k == j) - int(k == i)) for k in range(CLASSES)]
            out.append(F.when(cell[i] > 0, F.array(*moved)))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def _matrix(points: np.ndarray, letters: np.ndarray, kind: type) -> np.ndarray:
    """Letter counts of each word (a row of code points)."""
    rows, size = points.shape
    place = np.searchsorted(letters, points)
    flat = (np.arange(rows)[:, None] * len(letters) + place).ravel()
    return np.bincount(flat, minlength=rows * len(letters)).reshape(rows, len(letters)).astype(kind)


def _one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether rows of code points are exactly one replaced or (if shorter) one deleted code point apart."""
    size = shorter.shape[1]
    if longer.shape[1] == size:
        return (longer != shorter).sum(axis=1) == 1
    # All letters before some place agree from the left, all after it from the right.
    left, right = longer[:, :size] != shorter, longer[:, 1:] != shorter
    first = np.where(left.any(axis=1), left.argmax(axis=1), size)
    last = np.where(right.any(axis=1), size - 1 - right[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_in_blocks(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart: of ``a`` and ``b``, or of two words of ``a``.

    The words of a block have one length; those of ``b`` are as long as those of ``a``, or one code point shorter.
    """
    pa_, sa = _points(a)
    left = pa_.reshape(len(a), int(sa[0]))
    if b is None:
        right = left
    else:
        pb, sb = _points(b)
        right = pb.reshape(len(b), int(sb[0]))
    letters = np.unique(np.concatenate([left.ravel(), right.ravel()]))
    kind = np.float32 if left.shape[1] <= SINGLE else np.float64
    ca = _matrix(left, letters, kind)
    cb = ca if b is None else _matrix(right, letters, kind)
    # Two more columns turn the product into minus half the squared distance.
    one_a, one_b = np.ones((len(ca), 1), kind), np.ones((len(cb), 1), kind)
    norm_a, norm_b = (ca * ca).sum(axis=1, keepdims=True) / 2, (cb * cb).sum(axis=1, keepdims=True) / 2
    gram = np.hstack([ca, -norm_a, one_a]) @ np.hstack([cb, one_b, -norm_b]).T
    i, j = np.divmod(np.flatnonzero(gram >= -1), len(cb))
    if b is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    step = max(1, BLOCK_POINTS // max(1, left.shape[1]))
    for at in range(0, len(i), step):
        keep[at : at + step] = _one_edit(left[i[at : at + step]], right[j[at : at + step]])
    return i[keep], j[keep]


def _cut(joined: str, count: int) -> list[str]:
    size = len(joined) // count
    return [joined[k : k + size] for k in range(0, len(joined), size)]


PAIRS = "word string, n long, near string, near_n long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, an, b, bn in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            left = _cut(a, len(an))
            right = None if b is None else _cut(b, len(bn))
            i, j = near_in_blocks(left, right)
            if not len(i):
                continue
            other, on = (left, an) if right is None else (right, bn)
            w, wn = pa.array(left).take(pa.array(i)), pa.array(np.array(an, np.int64)[i])
            v, vn = pa.array(other).take(pa.array(j)), pa.array(np.array(on, np.int64)[j])
            for columns in ([w, wn, v, vn], [v, vn, w, wn]):
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``counts`` (word, n; distinct, not empty) one edit apart, both ways round."""
    cells = written(counts.select("word", "n").mapInArrow(_cells, "word string, n long, cell array<int>"), "words")
    # The number of blocks of a cell follows from its size, so that each holds a bounded number of words.
    size = F.aggregate("cell", F.lit(0), lambda t, c: t + c)
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_POINTS) / F.max(size))))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = cells.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("word", "n")))
    blocks = dealt.groupBy("cell", "block").agg(held.alias("held")).select(
        "cell", "block", F.array_join("held.word", "").alias("words"), F.col("held.n").alias("ns")
    )
    blocks = written(blocks, "blocks")
    left = blocks.select(F.col("cell").alias("from"), F.col("block").alias("_a"), "words", "ns", F.explode(_meeting()).alias("cell"))
    right = blocks.select("cell", F.col("block").alias("_b"), F.col("words").alias("words_b"), F.col("ns").alias("ns_b"))
    same = F.col("from") == F.col("cell")
    itself = same & (F.col("_a") == F.col("_b"))
    met = left.join(right, "cell").filter(~same | (F.col("_a") <= F.col("_b")))
    pairs = met.select("words", "ns", F.when(~itself, F.col("words_b")), F.when(~itself, F.col("ns_b")))
    return pairs.mapInArrow(_near, PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. Pointers are doubled; as every form is at least ``factor`` times as
    frequent as its word, a chain has at most 63 steps, so six rounds always reach its end."""
    hops = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = skew_join(hops, ahead, ["root"], "left")
        hops = written(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if hops.filter("_moved").isEmpty():
            break
        hops = hops.drop("_moved")
    return hops.select("word", "root")


def spelling_groups(counts: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is at least ``factor`` (2 or
    more) times as frequent as the word, else null; ``root`` is where the chain of forms ends, the word itself without a
    form; ``n_near`` counts the near words. A null or empty word takes no part. Rows that repeat a word count together.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    counts = counts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    found = near_words(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = counts.join(found, "word", "left").withColumn("_top", -F.col("best.order"))
    good = F.col("_top") >= factor * F.col("n")
    judged = written(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("_top")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

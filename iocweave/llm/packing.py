"""Packing by cutting-stock column generation.

Documents are cut at multiples of the sequence length; what remains of each is one piece. Pieces fall into length
classes of ``unit`` tokens, rounded up. The linear program that covers the histogram of classes with as few sequences
as possible is solved over patterns (pieces of each class in a sequence) that an unbounded knapsack prices one at a
time. Patterns are rounded down, and what is still uncovered is packed first-fit decreasing. The pieces of a class,
ranked, then take the places of its patterns in order.

Only the histogram (a row per class) and the patterns reach the driver; their number depends on the sequence length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iocweave.llm.common import written
from iocweave.llm.encoder import encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and the counts of a pattern: unbounded knapsack by dynamic programming over ascending sizes."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        n = fitting[room]
        if n:
            gains = duals[:n] + value[room - sizes[:n]]
            k = int(gains.argmax())
            if gains[k] > value[room] + 1e-12:
                value[room], took[room] = gains[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(value[capacity]), counts


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int = 4000, gap: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often the linear program uses them.

    Revised simplex: the basis starts with patterns of one class and a priced pattern enters in each round.
    It ends when no pattern is worth more than 1 + ``gap``, which is then the bound to the optimum.
    ``most_rounds`` bounds the work on the driver; the patterns found so far always cover the demand.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    for round_ in range(most_rounds):
        duals = inverse.sum(axis=0)
        best, entering = price(np.maximum(duals, 0), sizes, capacity)
        if best <= 1 + gap:
            break
        level, direction = inverse @ demand, inverse @ entering
        rows = direction > 1e-9
        if not rows.any():
            break
        ratio = np.where(rows, level / np.where(rows, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = entering
        if round_ % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            pivot = inverse[out] / direction[out]
            inverse -= np.outer(direction, pivot)
            inverse[out] = pivot
    return basis, np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) if m else demand.astype(float)


def cutting_stock(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and their numbers, which together have a place for every piece of the histogram (size: count)."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    if not len(sizes):
        return plan
    basis, use = column_generation(sizes, demand, capacity)
    left = demand.copy()
    for column, amount in zip(basis.T.astype(np.int64), np.floor(use + 1e-9).astype(np.int64), strict=True):
        taken = column > 0
        times = int(min(amount, (left[taken] // column[taken]).min())) if taken.any() else 0
        if times > 0:
            left -= column * times
            plan.append((dict(zip(sizes[taken].tolist(), column[taken].tolist(), strict=True)), times))
    # The rounded-off rest is less than a sequence for each pattern: first-fit decreasing.
    while left.any():
        room, counts = capacity, {}
        for k in range(len(sizes) - 1, -1, -1):
            n = int(min(left[k], room // sizes[k]))
            if n:
                counts[int(sizes[k])] = n
                room -= n * int(sizes[k])
        picked = [(k, counts[int(s)]) for k, s in enumerate(sizes) if int(s) in counts]
        times = int(min(left[k] // n for k, n in picked))
        for k, n in picked:
            left[k] -= n * times
        plan.append((counts, times))
    return plan


def _cut(tokenizer: str, end_id: int | None, size: int, with_ids: bool):
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, crc, total, values = [], [], [], [], [], []
            for name, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    doc.append(name)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
                    if with_ids:
                        values.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(
    documents: DataFrame, tokenizer: str, size: int = 4096, end_id: int | None = 2, unit: int = 16, salts: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of ``documents`` (doc_id, text) with their place: sequence_id and offset, gapless from 0 in each sequence.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``with_ids``. A null text is
    empty and has the end id only; without an end id, an empty document has no piece. Rows of equal doc_id are
    documents of their own. Other columns are not read. ``salts`` parts of each length class are ranked apart; there are
    as many as keep a part of a class below a few million pieces. A piece that leaves less than a ``unit`` is a sequence of
    its own, whatever ``size`` is; such pieces need no plan and no rank.
    """
    if size < 1 or unit < 1:
        raise ValueError("size and unit must be positive")
    unit = min(unit, size)
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_cut(tokenizer, end_id, size, with_ids), schema), "pieces")
    columns = pieces.columns
    capacity = size // unit
    full = pieces.filter(F.col("length") > (capacity - 1) * unit)
    pieces = pieces.filter(F.col("length") <= (capacity - 1) * unit)
    salts = salts or max(64, pieces.count() // 20_000_000)
    salt = F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")).withColumn("_salt", salt)

    # Ranks in two steps: within a part of a class, and the counts of the parts before it.
    counts = written(pieces.groupBy("_class", "_salt").agg(F.count("*").alias("_n")), "piece-counts")
    earlier = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_class", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("_rank", F.row_number().over(within) - 1)

    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    plan = cutting_stock(histogram, capacity)
    places, sequence, filled = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan:
        at = 0
        for cls in sorted(pattern, reverse=True):
            n = pattern[cls]
            places.append((cls, filled[cls], filled[cls] + n * times, n, sequence, at))
            filled[cls] += n * times
            at += n
        sequence += times
    layout = documents.sparkSession.createDataFrame(
        places, "_class int, _from long, _to long, _each long, _sequence long, _slot long"
    )
    # The layout has a row per class and pattern, a few thousand at most for any input.
    spot = F.col("_before") + F.col("_rank")
    placed = ranked.join(F.broadcast(before), ["_class", "_salt"]).join(
        F.broadcast(layout.withColumnRenamed("_class", "_c")),
        (F.col("_class") == F.col("_c")) & (spot >= F.col("_from")) & (spot < F.col("_to")),
    )
    inside = spot - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(inside / F.col("_each"))).withColumn(
        "_order", F.col("_slot") + inside % F.col("_each")
    )
    sofar = Window.partitionBy("sequence_id").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(sofar), F.lit(0)))
    # Sequences of full pieces follow those of the plan; their numbers are distinct, with gaps.
    alone = full.withColumns({"sequence_id": F.lit(sequence) + F.monotonically_increasing_id(), "offset": F.lit(0)})
    order = [
        *columns[:5], F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"),
        *columns[5:],
    ]
    return placed.select(*order).unionByName(alone.select(*order))

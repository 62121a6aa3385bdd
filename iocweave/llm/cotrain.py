"""Quality by co-training two views of a document.

The content view sees hashed words and shares of character classes, the metadata view sees source, language and size.
A logistic classifier of each view starts from labelled documents. In every round each one scores all unlabelled
documents, and confident ones of either class join the training set of the other, in the proportion that the classes
have. They are drawn by a hash among all that are confident enough: the very surest ones are all alike, and would teach
the other view what is odd about them. At the end both are calibrated on labelled documents kept apart, and their
evidence is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import chunks, rows_of, starts_of, word_hashes, words_of, written

WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 128, 128, 16
SHAPES = ("letters", "upper", "digits", "spaces", "marks", "symbols", "bars", "lines", "distinct", "word_length", "wide")
CONTENT = WORD_BUCKETS + len(SHAPES)
META = SOURCE_BUCKETS + LANG_BUCKETS + 3


def content_view(texts: pa.Array) -> np.ndarray:
    """A row of features for each text: unit-length counts of hashed words, then shares of kinds of characters."""
    out = []
    for part in chunks(texts, 4 << 20):
        counts, codes, words = words_of(rows_of(texts, part))
        bucket = (word_hashes(words) % np.uint64(WORD_BUCKETS)).astype(np.int64)[codes]
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        bag = np.bincount(owner * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, -1).astype(np.float64)
        norm = np.sqrt((bag**2).sum(axis=1, keepdims=True))
        bag /= np.maximum(norm, 1)
        pairs = np.unique(owner * (len(words) + 1) + codes)
        distinct = np.bincount(pairs // (len(words) + 1), minlength=n)
        held = [t or "" for t in rows_of(texts, part).to_pylist()]
        raw = np.frombuffer("".join(held).encode("utf-8", "replace"), np.uint8)
        at = starts_of(np.fromiter((len(t.encode("utf-8", "replace")) for t in held), np.int64, n))
        total = np.maximum(np.diff(at), 1)

        def share(flags: np.ndarray, at=at, total=total) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]) / total

        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        digit, space, wide = (raw >= 48) & (raw <= 57), (raw == 32) | ((raw >= 9) & (raw <= 13)), raw >= 128
        symbol = np.isin(raw, np.frombuffer(b"#*$%&<>", np.uint8))
        shapes = [
            share(lower), share(upper), share(digit), share(space), share(~(upper | lower | digit | space | wide)),
            share(symbol), 4 * share(raw == ord("|")), 4 * share(raw == 10), distinct / np.maximum(counts, 1),
            np.minimum(total / np.maximum(counts, 1), 40) / 10, share(wide),
        ]
        out.append(np.concatenate([bag, 3 * np.stack(shapes, axis=1)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, CONTENT))


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """A row of features for each document; a null is a value of its own, and an unknown size counts as absent."""
    out = np.zeros((len(source), META))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, xxhash.xxh64_intdigest(repr(s)) % SOURCE_BUCKETS] = 1
        out[i, SOURCE_BUCKETS + xxhash.xxh64_intdigest(repr(g)) % LANG_BUCKETS] = 1
        if n is not None and n >= 0:
            size = np.log1p(float(n)) / 5
            out[i, -3:] = 1, size, size * size
    return out


@dataclass
class Logistic:
    """Weights with the bias last, and the calibration of its log odds (slope, offset)."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights[:-1] + self.weights[-1]) + self.offset


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Newton steps on the ridge-penalised likelihood."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(w)


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Slope and offset of the log odds, fitted on documents that training has not seen."""
    if len(set(y.tolist())) < 2:
        return model
    platt = fit_logistic(model.log_odds(x)[:, None], y, ridge=0.1)
    return Logistic(model.weights, float(platt.weights[0]), float(platt.weights[1]))


@dataclass
class Model:
    content: Logistic
    meta: Logistic
    prior: float

    def log_odds(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each view, and of both: given the class the views are taken as independent, so the prior counts once."""
        a, b = self.content.log_odds(content), self.meta.log_odds(meta)
        return a, b, a + b - self.prior


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, content, meta): both views of each row as little-endian floats, in a table of the shared folder."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    rows = documents.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = content_view(batch.column("text")).astype("<f4")
            meta = meta_view(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r.tobytes() for r in v], pa.binary()) for v in (content, meta)]],
                ["doc_id", "content", "meta"],
            )

    return written(rows.mapInArrow(run, "doc_id long, content binary, meta binary"), "views")


def matrix(blobs: pa.Array | list, width: int) -> np.ndarray:
    items = blobs.to_pylist() if isinstance(blobs, pa.Array) else blobs
    return np.frombuffer(b"".join(items), "<f4").reshape(-1, width).astype(np.float64)


def _scores(model: Model):
    @F.arrow_udf("struct<content: double, meta: double, both: double>")
    def run(content: pa.Array, meta: pa.Array) -> pa.Array:
        parts = model.log_odds(matrix(content, CONTENT), matrix(meta, META))
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], ["content", "meta", "both"])

    return run


def train(
    views: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 3, exchange: int = 400, confidence: float = 0.9
) -> Model:
    """Co-train on at most ``sample`` labelled documents, chosen by a hash of doc_id; a quarter calibrates.

    In each of ``rounds`` all unlabelled documents are scored, and each view hands the other ``exchange`` documents (twice
    and three times as many in later rounds) to which it gives at least ``confidence``, divided as the labels are, in
    order of a hash of doc_id. Without labelled documents of both kinds every document gets even odds.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded, so it may be broadcast and collected.
    rows = views.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    content, meta = matrix([r["content"] for r in rows], CONTENT), matrix([r["meta"] for r in rows], META)
    held = np.arange(len(rows)) % 4 == 3
    if len(set(y[~held].tolist())) < 2:
        return Model(Logistic(np.zeros(CONTENT + 1)), Logistic(np.zeros(META + 1)), 0.0)
    unlabelled = written(views.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti"), "unlabelled")
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    edge = float(np.log(confidence / (1 - confidence)))
    sets = {"content": (content[~held], y[~held]), "meta": (meta[~held], y[~held])}
    columns = ["doc_id", "content", "meta"]
    taken: dict[str, set[int]] = {"content": set(), "meta": set()}
    for turn in range(rounds + 1):
        model = Model(fit_logistic(*sets["content"]), fit_logistic(*sets["meta"]), 0.0)
        if turn == rounds:
            break
        scored = unlabelled.select(*columns, _scores(model)("content", "meta").alias("s"))
        for view, other in (("content", "meta"), ("meta", "content")):
            sure = []
            odds = F.col(f"s.{view}")
            for label, confident, part in ((0, odds <= -edge, 1 - share), (1, odds >= edge, share)):
                drawn = scored.filter(confident).orderBy(F.xxhash64("doc_id"), "doc_id").limit(round(exchange * part * (turn + 1)))
                sure += [(r, label) for r in drawn.select(*columns).collect()]
            fresh = []
            for r, label in sure:
                if r["doc_id"] not in taken[other]:
                    taken[other].add(r["doc_id"])
                    fresh.append((r, label))
            if fresh:
                x = matrix([r[other] for r, _ in fresh], CONTENT if other == "content" else META)
                sets[other] = (
                    np.concatenate([sets[other][0], x]), np.concatenate([sets[other][1], [float(v) for _, v in fresh]])
                )
    return Model(
        calibrate(model.content, content[held], y[held]), calibrate(model.meta, meta[held], y[held]),
        float(np.log(share / (1 - share))),
    )


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """(doc_id, content_score, meta_score, score, kept) for each row of ``documents`` (doc_id, text, source, lang,
    n_chars); the scores are probabilities of good quality.

    A null text is empty, nulls of the other columns are values of their own, repeated rows come back as often as they
    occur, and further columns are not read. ``settings`` go to ``train``.
    """
    views = features(documents)
    model = train(views, labels, **settings)
    logistic = lambda c: 1 / (1 + F.exp(-c))
    scored = views.select("doc_id", _scores(model)("content", "meta").alias("s")).select(
        "doc_id", logistic(F.col("s.content")).alias("content_score"), logistic(F.col("s.meta")).alias("meta_score"),
        logistic(F.col("s.both")).alias("score"),
    )
    return scored.withColumn("kept", F.col("score") >= threshold)

"""Quality rules by line labelling: a linear-chain conditional random field over the lines of a document.

Each line is content (1) or boilerplate (0). The field scores a line by its features and a pair of neighbours by their
labels; Viterbi decoding finds the best labelling of a document, and the share of words in content lines decides.
It is trained on documents with a quality label: the lines of a poor document count as boilerplate, those of a good one
as content unless they repeat an earlier line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import chunks, rows_of, same_columns, starts_of, words_of

#: Texts are described in pieces of about so many bytes: a line's features take some forty times its own size.
PIECE_BYTES = 1 << 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = (
    "one", "symbols", "upper", "digits", "other_marks", "repeated_words", "repeated_line", "short", "word_length",
    "long_words", "ends_sentence", "bars", "exclamations",
)
RESULT = (
    "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
    "base_failed: boolean, content_share: double, kept: boolean>"
)


def _class_table() -> np.ndarray:
    """Bits for each character of the basic plane: 1 symbol, 2 upper case, 4 digit, 8 letter, 16 white space."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = (c in SYMBOLS) + 2 * c.isupper() + 4 * c.isdigit() + 8 * c.isalpha() + 16 * (c in SPACES)
    return out


_classes: list[np.ndarray] = []


def _char_classes(codes: np.ndarray) -> np.ndarray:
    if not _classes:
        _classes.append(_class_table())
    return _classes[0][np.minimum(codes, 0xFFFF)]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, of which some may be empty."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    wide = int(second.max()) + 1 if len(second) else 1
    return np.unique(first * wide + second, return_inverse=True)[1].astype(np.int64)


@dataclass
class Lines:
    """Counts and features of the lines of some texts."""

    per_text: np.ndarray
    words: np.ndarray
    features: np.ndarray
    repeated: np.ndarray
    base: dict[str, np.ndarray]


def describe(texts: pa.Array, window: int = 5) -> Lines:
    """Lines of each text (split at \\n) with their features, and the counts of each text. A null text has no words."""
    held = [t or "" for t in texts.to_pylist()]
    split = [t.split("\n") for t in held]
    per_text = np.fromiter(map(len, split), np.int64, len(split))
    lines = [line for part in split for line in part]
    n_lines = len(lines)
    text_of = np.repeat(np.arange(len(held)), per_text)

    joined = "\n".join(lines) + "\n" if lines else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _char_classes(codes)
    at = starts_of(np.fromiter(map(len, lines), np.int64, n_lines) + 1)
    size = np.maximum(np.diff(at) - 1, 1)
    space = (kind & 16) > 0
    symbols, upper, digits, letters = (_sums((kind & b) > 0, at) for b in (1, 2, 4, 8))
    chars = _sums(~space, at)
    bars = _sums(codes == ord("|"), at)
    shouts = _sums(codes == ord("!"), at)

    counts, word, _ = words_of(pa.array(lines, pa.large_string()))
    line_of = np.repeat(np.arange(n_lines), counts)
    # Distinct words of each line, and distinct words over nine characters are taken from their number.
    keys = np.unique(line_of * (int(word.max()) + 1 if len(word) else 1) + word)
    distinct = np.bincount(keys // (int(word.max()) + 1 if len(word) else 1), minlength=n_lines) if len(keys) else np.zeros(n_lines)
    some = np.maximum(counts, 1)

    repeated = np.zeros(n_lines, bool)
    seen: set[str] = set()
    last = -1
    for i, (t, line) in enumerate(zip(text_of.tolist(), lines, strict=True)):
        if t != last:
            seen, last = set(), t
        if counts[i]:
            repeated[i] = line in seen
            seen.add(line)
    ends = np.fromiter((line.rstrip()[-1:] in (".", "!", "?", ":", ";") for line in lines), bool, n_lines)
    length = chars / some
    features = np.stack(
        [
            np.ones(n_lines), symbols / some, upper / np.maximum(letters, 1), digits / size,
            (chars - letters - digits - symbols) / some, 1 - distinct / some, repeated, counts < 4, length / 10,
            length > 14, ends, bars / some, shouts / some,
        ],
        axis=1,
    ).astype(np.float64)
    features[:, 1:] = np.clip(features[:, 1:], 0, 3)
    features[counts == 0] = 0

    # Words in windows that occur twice in their text: exact numbers of pairs, then of fours, then of fives.
    n = starts_of(np.bincount(text_of, weights=counts, minlength=len(held)).astype(np.int64))
    owner = np.repeat(np.arange(len(held)), np.diff(n))
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= window:
        run, width = _ranks(owner, word), 1
        while width < window:
            step = min(width, window - width)
            run = _ranks(run[:-step], run[step:])
            width += step
        inside = owner[: len(run)] == owner[window - 1 :]
        run = run[inside]
        again = np.flatnonzero(inside)[np.bincount(run)[run] > 1] if len(run) else np.zeros(0, np.int64)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    in_window = np.cumsum(covered[:-1]) > 0
    lines_at = starts_of(per_text)
    n_words = np.diff(n)
    base = {
        "n_words": n_words,
        "word_chars": _sums(chars, lines_at),
        "n_symbols": _sums(symbols, lines_at),
        "n_dup_lines": _sums(repeated, lines_at),
        "n_repeat_words": _sums(in_window, n),
    }
    return Lines(per_text, counts, features, repeated, base)


@dataclass
class Field:
    """Weights: ``emit`` (features x 2 labels) and ``move`` (2 x 2, from the earlier line's label)."""

    emit: np.ndarray
    move: np.ndarray

    @staticmethod
    def untrained() -> Field:
        """Without usable labels every line counts as content."""
        emit = np.zeros((len(FEATURES), 2))
        emit[0, 1] = 1.0
        return Field(emit, np.zeros((2, 2)))


def viterbi(field: Field, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The best labels of all lines. Texts are decoded side by side, one line of each at a time."""
    score = features @ field.emit
    at = starts_of(per_text)
    order = np.argsort(-per_text, kind="stable")
    first, most = at[:-1][order], per_text[order]
    labels = np.zeros(len(score), np.int8)
    if not len(score):
        return labels
    came = np.zeros((len(score), 2), np.int8)
    best = np.zeros((len(order), 2))
    longest = int(most.max())
    alive = [int(np.searchsorted(-most, -t, "left")) for t in range(longest + 1)]
    for t in range(longest):
        k = alive[t]
        rows = first[:k] + t
        if t:
            ways = best[:k, :, None] + field.move
            came[rows] = ways.argmax(axis=1)
            best[:k] = ways.max(axis=1)
        best[:k] += score[rows]
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        rows = first[:k] + t
        labels[rows] = now[:k]
        if t:
            now[:k] = came[rows, now[:k]]
    return labels


def train(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 200, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent (Adam); expected counts come from the forward-backward recursion."""
    if not sequences:
        return Field.untrained()
    n, longest = len(sequences), max(map(len, sequences))
    x = np.zeros((n, longest, len(FEATURES)))
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (s, own) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, own, True
    hot = np.eye(2)[y] * mask[:, :, None]
    pair = mask[:, 1:] & mask[:, :-1]
    seen_emit = np.einsum("ntf,ntk->fk", x, hot)
    seen_move = np.einsum("nti,ntj->ij", hot[:, :-1] * pair[:, :, None], hot[:, 1:])
    total = mask.sum()
    weights = np.zeros((len(FEATURES) + 2, 2))
    first_moment, second_moment = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        emit, move = weights[:-2], weights[-2:]
        score = x @ emit
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            ways = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1])
            forward[:, t] = np.where(mask[:, t, None], ways + score[:, t], forward[:, t - 1])
        log_z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        back = np.zeros((n, longest, 2))
        expect_move = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + back[:, t + 1]
            ways = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            joint = forward[:, t, :, None] + move + ahead[:, None, :] - log_z[:, None, None]
            expect_move += np.exp(np.where(pair[:, t, None, None], joint, -np.inf)).sum(axis=0)
            back[:, t] = np.where(mask[:, t + 1, None], ways, 0)
        share = np.exp(np.where(mask[:, :, None], forward + back - log_z[:, None, None], -np.inf))
        gradient = np.concatenate([seen_emit - np.einsum("ntf,ntk->fk", x, share), seen_move - expect_move]) / total
        gradient -= ridge * weights
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second_moment = 0.999 * second_moment + 0.001 * gradient**2
        weights += rate * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.999**step)) + 1e-8)
    return Field(weights[:-2].copy(), weights[-2:].copy())


def fit(documents: DataFrame, labels: DataFrame, sample: int = 1500, most_lines: int = 48) -> Field:
    """Train on at most ``sample`` labelled documents, chosen by a hash of doc_id; labels has (doc_id, quality 0 or 1).

    A longer document gives several sequences of ``most_lines`` lines, of which the first two are used. Rows without
    an id or a quality are passed over. Without documents of both kinds the field is untrained.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )

    @F.arrow_udf("struct<features: array<array<double>>, repeated: array<boolean>>")
    def measure(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks(texts, PIECE_BYTES):
            lines = describe(rows_of(texts, part))
            at = starts_of(lines.per_text).tolist()
            for a, b in zip(at, at[1:], strict=False):
                b = min(b, a + 2 * most_lines)
                out.append({"features": lines.features[a:b].tolist(), "repeated": lines.repeated[a:b].tolist()})
        kind = pa.struct([("features", pa.list_(pa.list_(pa.float64()))), ("repeated", pa.list_(pa.bool_()))])
        return pa.array(out, kind)

    # The sample is bounded, so it may be broadcast.
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])
    sequences, targets, kinds = [], [], set()
    for row in rows.select("_quality", measure("_text").alias("_m")).collect():
        features, repeated = np.array(row["_m"]["features"]), np.array(row["_m"]["repeated"])
        target = np.full(len(features), row["_quality"]) & ~repeated
        kinds.add(row["_quality"])
        for a in range(0, len(features), most_lines):
            sequences.append(features[a : a + most_lines])
            targets.append(target[a : a + most_lines].astype(np.int64))
    return train(sequences, targets) if len(kinds) == 2 else Field.untrained()


def verdict(text: Column, field: Field, min_share: float = 0.5) -> Column:
    """Counts of a text, whether it fails the base rules, its share of content words, and whether it is kept."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks(texts, PIECE_BYTES):
            lines = describe(rows_of(texts, part))
            content = viterbi(field, lines.features, lines.per_text) == 1
            n = lines.base["n_words"]
            share = _sums(lines.words * content, starts_of(lines.per_text)) / np.maximum(n, 1)
            failed = (n < 10) | (100 * lines.base["n_repeat_words"] > 20 * n)
            arrays = [pa.array(v.astype(np.int64)) for v in lines.base.values()]
            arrays += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_share))]
            names = [*lines.base, "base_failed", "content_share", "kept"]
            out.append(pa.StructArray.from_arrays(arrays, names))
        return pa.chunked_array(out).combine_chunks() if out else pa.array([], kind)

    kind = pa.struct(
        [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())]
    )
    return run(text.cast("string"))


def judge(documents: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, content_share, kept) for each row; repeated rows come back as often, a null text
    has no words and fails, and other columns are not read."""
    rows = documents.select("doc_id", verdict(F.col("text"), field, min_share).alias("_v"))
    return rows.select("doc_id", "_v.*")


def keep_content(documents: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns."""
    marked = documents.withColumn("__llm_verdict", verdict(F.col("text"), field, min_share))
    return marked.filter("__llm_verdict.kept").select(*same_columns(documents))

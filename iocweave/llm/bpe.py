"""Byte-level BPE by speculation and verification.

A greedy longest match proposes the tokens of a word. A sequence of tokens is what the merges give exactly if each
adjacent pair is compatible: merging the two tokens' bytes together leaves the border between them. Compatibility is
tested for all new pairs at once, and only words with a failing pair are merged step by step.

Compatibility of (a, b): while a and b are built, the border has a right-most part of a on one side and a left-most part
of b on the other. Each part exists from the merge that made it to the merge that takes it in. The border falls if for
two parts that exist together there is a merge of the two that comes before either is taken in.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import chunks, gather, rows_of, starts_of

# Fixed value: the pattern that cuts a text into words before any merge.
PRETOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NEVER = 1 << 40
CACHE_UNITS = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        names = spec["model"]["vocab"]
        self.size = max([*names.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * self.size
        self.id_of: dict[bytes, int] = {}
        for name, i in names.items():
            if name not in self.specials:
                raw = bytes(letters[c] for c in name)
                self.bytes_of[i] = raw
                self.id_of[raw] = i
        for name, i in self.specials.items():
            self.bytes_of[i] = name.encode()
        self.single = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        self.prefixes = {raw[:k] for raw in self.id_of for k in range(1, len(raw) + 1)}
        # Merge ranks by pair, and how each token is made.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(self.size, -1), np.full(self.size, -1)
        made = np.full(self.size, -1)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = names[a], names[b]
            z = names[a + b]
            self.rank.setdefault((x, y), (r, z))
            if made[z] < 0:
                left[z], right[z], made[z] = x, y, r
        self.left, self.right, self.made = left, right, made
        keys = np.array([x * self.size + y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        # A token that merging its own bytes would not give can never be proposed.
        self.reachable = np.zeros(self.size, bool)
        for raw, i in self.id_of.items():
            self.reachable[i] = len(raw) == 1 or made[i] >= 0
        whole = np.array([i for i in self.id_of.values() if made[i] >= 0])
        self.reachable[whole] = self.compatible(left[whole], right[whole], below=made[whole])
        self.usable = {raw: i for raw, i in self.id_of.items() if self.reachable[i]}
        self.good_pairs = np.zeros(0, np.int64)
        self.bad_pairs = np.zeros(0, np.int64)
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether the border of each pair stands; ``below``: up to the merge of that rank, which joins the two.

        Goes back in time: of the two parts at the border the one made later is undone first. At equal ranks the
        left one was made first, as merges of one rank are done from the left.
        """
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        end = np.full(len(x), NEVER) if below is None else np.array(below, np.int64)
        end_x, end_y = end.copy(), end.copy()
        stands = np.ones(len(x), bool)
        open_ = np.arange(len(x))
        while len(open_):
            px, py = x[open_], y[open_]
            rank = self._pair_rank(px, py)
            falls = (rank < end_x[open_]) & (rank <= end_y[open_]) & (rank < end[open_])
            stands[open_[falls]] = False
            mx, my = self.made[px], self.made[py]
            undo_y = (my >= mx) & (my >= 0)
            undo_x = ~undo_y & (mx >= 0)
            for undo, value, made, ends, part in ((undo_x, x, mx, end_x, self.right), (undo_y, y, my, end_y, self.left)):
                rows = open_[undo]
                ends[rows] = made[undo]
                value[rows] = part[value[rows]]
            open_ = open_[~falls & (undo_x | undo_y)]
        return stands

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        usable, prefixes = self.usable, self.prefixes
        whole = usable.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            best, end = usable[word[at : at + 1]], at + 1
            stop = at + 2
            while stop <= n and word[at:stop] in prefixes:
                token = usable.get(word[at:stop])
                if token is not None:
                    best, end = token, stop
                stop += 1
            out.append(best)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, from the left; a heap keeps long words near linear."""
        ids = [self.single[c] for c in word]
        if len(ids) < 40:
            return self._merge_short(ids)
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        alive = [True] * len(ids)
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.rank.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j] = z, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def _merge_short(self, ids: list[int]) -> list[int]:
        last = (NEVER, -1)
        get = self.rank.get
        ranks = [get(pair, last) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best[0] == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), last)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), last)
        return ids

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words that no special token and no pattern border cuts."""
        proposed = [self.propose(w) for w in words]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        if len(flat) < 2:
            return proposed
        owner = np.repeat(np.arange(len(proposed)), size)
        inside = owner[:-1] == owner[1:]
        pairs, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        stands = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(owner[:-1][inside][~stands[back]])
        for i in failing.tolist():
            proposed[i] = self.merge(words[i])
        return proposed

    def _units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units: pieces of text that are cut into words by themselves."""
        found = [self.young.get(u) for u in units]
        missing = [i for i, v in enumerate(found) if v is None]
        fresh = []
        for i in missing:
            if (v := self.old.get(units[i])) is None:
                fresh.append(i)
            else:
                found[i] = v
        cut = [PRETOKENS.findall(units[i]) for i in fresh]
        distinct = list({w for part in cut for w in part})
        ids = dict(zip(distinct, self.words([w.encode() for w in distinct]), strict=True))
        for i, part in zip(fresh, cut, strict=True):
            found[i] = np.array([t for w in part for t in ids[w]], "<i4").tobytes()
        if len(self.young) + len(missing) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        self.young.update((units[i], found[i]) for i in missing[:CACHE_UNITS] if len(units[i]) < 200)
        return found

    def _pieces(self, text: str) -> list[tuple[str, int | None]]:
        """A text cut at special tokens: ordinary text, or a special token with its id."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += [(text[at : m.start()], None), (m[0], self.specials[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of token ids; a null text is empty."""
        out, lengths = [], []
        for part in chunks(texts, 4 << 20):
            held = pc.fill_null(rows_of(texts, part).cast(pa.large_string()), "")
            # A space after a character that is no white space starts a new word, whatever follows but white space.
            split = pc.split_pattern(held, " ")
            coded = split.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            # A piece that is empty or ends in white space needs what follows; such texts are cut as a whole.
            words = coded.dictionary
            loose = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_rtrim_whitespace(words), words))
            for s in self.specials:
                loose = pc.or_(loose, pc.match_substring(words, s))
            codes = np.asarray(coded.indices)
            at = np.asarray(split.offsets)
            at = (at - at[0]).tolist() if len(at) else [0]
            hard = loose.to_numpy(zero_copy_only=False)[codes]
            spaced = self._units([" " + w for w in names])
            hard = np.concatenate([[0], np.cumsum(hard)])
            whole = [i for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if hard[b] > hard[a]]
            # The first piece of a text has no space before it, and whole texts take the place of all their pieces.
            first = [c for c in dict.fromkeys(codes[a] for a, b in zip(at, at[1:], strict=False) if b > a)]
            opened = {c: len(names) + k for k, c in enumerate(first)}
            parts = spaced + self._units([names[c] for c in first])
            slow = {}
            for i in whole:
                slow[i] = len(parts)
                parts.append(self._whole(held[i].as_py()))
            drawn = []
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if i in slow:
                    drawn.append(np.array([slow[i]]))
                elif b > a:
                    drawn.append(np.concatenate([[opened[codes[a]]], codes[a + 1 : b]]))
                else:
                    drawn.append(np.zeros(0, np.int64))
            values, starts = gather(parts, np.concatenate(drawn).astype(np.int64) if drawn else np.zeros(0, np.int64))
            ends = starts[starts_of(np.fromiter(map(len, drawn), np.int64, len(drawn)))]
            out.append(values)
            lengths.append(np.diff(ends))
        flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        offsets = starts_of(np.concatenate(lengths)) if lengths else np.zeros(1, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))

    def _whole(self, text: str) -> bytes:
        """Ids of a text that is cut as a whole."""
        joined = []
        for piece, special in self._pieces(text):
            if special is not None:
                joined.append(np.array([special], "<i4").tobytes())
            elif piece:
                cut = PRETOKENS.findall(piece)
                distinct = list(set(cut))
                ids = dict(zip(distinct, self.words([w.encode() for w in distinct]), strict=True))
                joined.append(np.array([t for w in cut for t in ids[w]], "<i4").tobytes())
        return b"".join(joined)

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids, special tokens included; bytes that are no UTF-8 become replacement characters, and
        an id that the vocabulary lacks stands for nothing."""
        out = []
        known = self.bytes_of
        for row in ids:
            if not row.is_valid:
                out.append(None)
                continue
            values = row.values.to_numpy(zero_copy_only=False).tolist()
            out.append(b"".join([known[t] for t in values if 0 <= t < self.size]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())


_loaded: dict[str, SpeculativeBpe] = {}


def model(path: str) -> SpeculativeBpe:
    """One model per worker process and file."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def encoded(text: Column, path: str) -> Column:
    """Token ids of a text as an array of ints; a null text is empty."""

    @F.arrow_udf("array<int>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield model(path).encode(texts)

    return run(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids; null ids give null."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in it:
            yield model(path).decode(values)

    return run(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``documents``; rows come back as often as they occur."""
    rows = documents.select("doc_id", encoded(F.col("text"), path).alias("ids"))
    return rows.withColumn("decoded", decoded(F.col("ids"), path))

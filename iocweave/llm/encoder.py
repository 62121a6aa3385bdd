"""Token ids of whole texts by a word-level tokenizer of the tokenizers library."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from iocweave.llm.common import chunks, rows_of, starts_of

#: Word parts held per worker, and their bytes at most; a part that is not held is encoded again.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 24 << 20
#: Letters of ASCII and Latin-1, then ASCII marks; an apostrophe may belong to letters after it.
_LETTERS, _MARKS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", r"!-&(-/:-@\[-`{-~"
LETTERS_MARKS = f"^(?P<head>[{_LETTERS}]+)(?P<tail>[{_MARKS}]*)$"
SIMPLE = f"^(?:[{_LETTERS}]+|[{_MARKS}]+)$"


class WordEncoder:
    """Encodes each distinct word once.

    Right for tokenizers that drop white space: no token, normalisation or special token then reaches over white
    space, so the ids of a text are those of its words. Words are joined by a special token, which the library cuts
    out before anything else; a word that itself holds a special token is encoded alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark_id, self.mark = min(special.items())
        self.special = list(special.values())
        # Lower-case letters alone (none of which joins another), or marks alone: no normalising and cutting is needed,
        # only the merges, and the last token of each shows that it ends there.
        suffix = self.tokenizer.model.end_of_word_suffix
        self.merges = None
        if suffix:
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Parts that were encoded, and their ids end to end; the empty part has none."""
        self.held = pa.array([""], pa.large_string())
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _batches(self, tokenizer, between: str, words: list[str]) -> Iterator[np.ndarray]:
        """Ids of words, several hundred to a text."""
        # Encodings hold far more than ids, so only a few thousand words are encoded at once.
        for start in range(0, len(words), 10_000):
            stop = min(start + 10_000, len(words))
            texts = [between.join(words[at : min(at + 500, stop)]) for at in range(start, stop, 500)]
            for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(encoding.ids, np.uint32)

    def _by_merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters or of marks, and how many each has."""
        ids = np.concatenate([np.zeros(0, np.uint32), *self._batches(self.merges, " ", words)])
        ends = np.flatnonzero(self.last[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without special tokens, and how many each has."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for ids in self._batches(self.tokenizer, self.mark, words):
            cuts = np.flatnonzero(ids == self.mark_id)
            flat.append(np.delete(ids, cuts))
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for part in ids for i in part], np.uint32), np.array([len(part) for part in ids], np.int64)

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which parts that are not held were encoded, their ids, and how many each has. One that holds a
        special token is encoded alone."""
        alone = np.zeros(len(parts), bool)
        for mark in self.special:
            alone |= pc.match_substring(parts, mark).to_numpy(zero_copy_only=False)
        simple = np.zeros(len(parts), bool)
        if self.merges is not None:
            simple = pc.match_substring_regex(parts, SIMPLE).to_numpy(zero_copy_only=False)
        groups = [(simple, self._by_merges), (~simple & ~alone, self._by_library), (~simple & alone, self._alone)]
        done = [how(parts.filter(pa.array(which)).to_pylist()) for which, how in groups]
        order = np.concatenate([np.flatnonzero(which) for which, _ in groups])
        return order, np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts are held; those that are not are encoded and held now."""
        at = pc.index_in(parts, value_set=self.held)
        if not at.null_count:
            return at.to_numpy()
        if len(self.held) + at.null_count > CACHE_WORDS or self.held.nbytes > CACHE_BYTES:
            # Begin again with what is wanted now.
            self._forget()
            at = pc.index_in(parts, value_set=self.held)
        new = parts.filter(pc.is_null(at))
        order, ids, sizes = self._encoded(new)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        places = np.empty(len(new), np.int64)
        places[order] = np.arange(len(self.held), len(self.held) + len(new))
        self.held = pa.concat_arrays([self.held, new.take(pa.array(order))])
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = places
        return out

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and where those of each start. Letters and the marks that follow them are
        tokens apart, whatever their case, so such words are put together from two parts."""
        cut = pc.extract_regex(words, LETTERS_MARKS)
        plain = pc.is_valid(cut)
        head = pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, "head")), words)
        tail = pc.if_else(plain, pc.struct_field(cut, "tail"), pa.scalar("", pa.large_string()))
        coded = pa.concat_arrays([head, tail]).dictionary_encode()
        at = self._places(coded.dictionary)[np.asarray(coded.indices)]
        both = np.stack([at[: len(words)], at[len(words) :]], axis=1).ravel()
        ids, starts = picked(self.ids, self.starts, both)
        return ids, starts[::2]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where those of each start (and end); a null text has none."""
        flat, sizes = [], [np.zeros(1, np.int64)]
        for part in chunks(texts):
            # White space as the tokenizer sees it is wider, but these characters are always white space to it.
            split = pc.ascii_split_whitespace(pc.fill_null(rows_of(texts, part).cast(pa.large_string()), ""))
            coded = split.flatten().dictionary_encode()
            values, starts = picked(*self._of_words(coded.dictionary), np.asarray(coded.indices))
            at = np.asarray(split.offsets)
            flat.append(values)
            sizes.append(np.diff(starts[at - at[0]]))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.cumsum(np.concatenate(sizes))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        ids, starts = self.encode_flat(texts)
        raw, ends = ids.astype("<u4").tobytes(), (4 * starts).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def picked(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[c]:starts[c + 1]]`` of all codes end to end, and where each starts (and ends)."""
    at = starts_of(starts[codes + 1] - starts[codes])
    spots = np.arange(at[-1]) + np.repeat(starts[codes] - at[:-1], np.diff(at))
    return values[spots], at


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


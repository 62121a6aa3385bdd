"""Texts and names for the tests."""

import random

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or inside.
CLASHING = (
    "n_words kept start _hash _key fp root bucket _marks h n w key pos line_no ids score component_id fingerprint offset "
    "length spans content meta label y shard dim part vector embedding2"
).split()

ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "  lead and trail  ", "tab\tand\x0bvertical\x0cfeed\r\nreturn", "a  b   c",
    "x<|endoftext|>y", "é ñ ß 日本語 🙂", "it's we'LL I'd", "no break narrow", "word " * 3000, "a" * 4000, "ab" * 1500 + "\n" + "!" * 500,
]

VOCABULARY = [f"{a}{b}" for a in "ban cor del fin gar hol jin kam".split() for b in "do ri su me na".split()]


def prose(rng: random.Random, lines: int, words: int = 12) -> str:
    return "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(words)).capitalize() + "." for _ in range(lines))

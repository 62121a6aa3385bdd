"""Worst cases: long chains, long texts, extreme vectors, odd sizes. The times are bounds that a quadratic way would miss."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from iocweave.llm import ann, line_dedup, packing, pii
from iocweave.llm.components import components
from tests.llm.helpers import CLASHING
from tests.llm.test_tokens import WORD


def test_long_chains_in_few_rounds(spark):
    """A chain in ascending order, one shuffled, a hub, a ring, and edges that say nothing."""
    n = 10_000
    shuffled = list(range(20_000, 22_000))
    random.Random(1).shuffle(shuffled)
    ring = [(30_000 + i, 30_000 + (i + 1) % 999) for i in range(999)]
    hub = [(40_000 + i, 49_999) for i in range(3000)]
    data = [(i, i + 1) for i in range(n)] + list(zip(shuffled, shuffled[1:], strict=False)) + ring + hub + [(7, 7), (50_000, 50_000), (None, 3), (1, 2), (2, 1)]
    got = components(spark.createDataFrame(data, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len(got) == len(roots) == n + 1 + 2000 + 999 + 3001
    want = [(range(n + 1), 0), (shuffled, 20_000), (range(30_000, 30_999), 30_000), ([*range(40_000, 43_000), 49_999], 40_000)]
    assert all(roots[i] == root for nodes, root in want for i in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_against_a_search(spark):
    rng = random.Random(8)
    data = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links = {}
    for a, b in data:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = start
                todo += links[node]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(data, "a long, b long")).collect()}
    assert got == want


OLD_PATTERN = re.compile(r"(?P<email>[^\W_][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})|" + pii.PATTERN.pattern)


def test_values_found_are_those_of_one_pattern():
    rng = random.Random(4)
    bits = ["a", "_", ".", "@", "x.org", "b@c.de", "4111 1111 1111 1111", "1.2.3.4", " ", "2024-01-31", "é", "%", "555-123-4567", "-", "0123456789abcdef" * 2, "\n", "31.12.2024"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        want = [(m.start(), m.end(), next(k for k in pii.KINDS if m[k] is not None)) for m in OLD_PATTERN.finditer(text)]
        assert list(pii.found_values(text)) == want, text


@pytest.mark.parametrize("unit", ["a", "a.", "1", "12-", "@", "a@", "a@b.", "AB12 ", "1.2."])
def test_long_runs_take_linear_time(unit):
    text = unit * (2_000_000 // len(unit))
    start = time.process_time()
    pii.pseudonymise(text, b"k")
    assert time.process_time() - start < 60


def test_text_of_many_lines(spark, make):
    """200,000 lines, half of them repeated; the work grows with the lines."""
    lines = [f"line {i % 100_000} of a long text with some words" if i % 2 else f"short {i % 1000}" for i in range(200_000)]
    seen, want = set(), []
    for line in lines:
        if line not in seen:
            seen.add(line)
            want.append(line)
    start = time.time()
    got = line_dedup.dedup_lines(make([(1, "\n".join(lines)), (2, "short 8\n\nshort x")])).select("doc_id", "text").collect()
    took = time.time() - start
    texts = {r["doc_id"]: r["text"].split("\n") for r in got}
    # Long lines differ in one word, so the first one stands for all; short ones are compared as a whole.
    assert texts[1] == [w for w in want if w.startswith("short") or w == want[1]]
    assert texts[2] == ["", "short x"] and took < 120


@pytest.mark.parametrize("offset, scale, far", [(0, 1, 0), (1e4, 1, 0), (1e5, 1, 0), (0, 1e20, 0), (0, 1e-25, 0), (3e-20, 1e-25, 0), (0, 1, 1e20), (5, 1, 1e9)])
def test_recall_wherever_the_vectors_are(spark, offset, scale, far):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16)) * scale + offset
    if far:  # a few a long way out, in a cluster of their own
        vectors[::50] += far
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING[:3]})
    found = {}
    for r in ann.nearest(rows, every=25, settings=ann.Settings(shard_rows=800)).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q, ids in found.items():
        order = np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1), kind="stable")
        hits += len(set(ids) & {int(i) for i in order[order != q][:10]})
    assert len(found) == 60 and hits >= 0.9 * 600


@pytest.mark.parametrize("size, unit", [(100, 16), (16, 16), (7, 16), (1, 1), (33, 10), (64, 64), (4096, 16)])
def test_packing_at_any_size(make, size, unit):
    rng = random.Random(size)
    docs = make([(i, " ".join(rng.choice(["some", "words", "x9"]) for _ in range(rng.randrange(300)))) for i in range(60)])
    rows = packing.pack(docs, WORD, size=size, unit=unit).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    tokens = {}
    for r in rows:
        tokens.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in tokens.values():
        assert sum(p[1] for p in parts) == parts[0][2] and sorted(p[0] for p in parts)[0] == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, size=0)


def test_far_vectors_keep_their_direction():
    exact = np.vstack([np.eye(4) * 1e-30, np.full((1, 4), 1e30)])
    framed = ann.framed(exact, *ann.frame(exact))
    assert np.isfinite(framed).all() and framed.dtype == np.float32
    assert pa.array(framed[-1]).null_count == 0

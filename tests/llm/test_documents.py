"""Line labels, line dedup, near duplicates and repeated passages against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from iocweave.llm import components, line_crf, line_dedup, simhash, windows
from tests.llm.helpers import CLASHING, VOCABULARY, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def order(i):
    return (i is not None, i or 0)


# --- line labels --------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeats += line in seen
            seen.add(line)
    windows_of = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = collections.Counter(windows_of)
    covered = {k + j for k, x in enumerate(windows_of) if often[x] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), failed


def junk(rng, lines):
    return "\n".join(" ".join(rng.choice(VOCABULARY) + rng.choice(["###", "$$$", "|", "***"]) for _ in range(9)) for _ in range(lines))


@pytest.fixture(scope="module")
def field(spark, make):
    rng = random.Random(1)
    rows = [(i, junk(rng, 4) if i % 3 == 0 else prose(rng, 5)) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)] + [(None, 1), (7, None)], "doc_id long, quality int")
    return line_crf.fit(make(rows), labels)


def test_base_counts(odd, field, spark):
    rows = line_crf.judge(odd, field).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((order(r["doc_id"]), tuple(r[c] for c in names)) for r in rows)
    want = sorted((order(r[0]), base_counts(r[1])) for r in odd.select("doc_id", "text").collect())
    assert got == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_counts_across_chunks():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 6), 7) + "\n" + rng.choice(["same line of it", "", "x # y | z"]) for _ in range(200)] + [None, ""]
    lines = line_crf.describe(pa.array(texts))
    got = list(zip(*(v.tolist() for v in lines.base.values()), strict=True))
    assert got == [base_counts(t)[:5] for t in texts]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    field = line_crf.Field(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
    per_text = np.array([0, 5, 1, 7, 0, 3])
    x = rng.normal(size=(per_text.sum(), len(line_crf.FEATURES)))
    labels = line_crf.viterbi(field, x, per_text)
    at = 0
    for n in per_text:
        score = x[at : at + n] @ field.emit
        best = max(
            itertools.product((0, 1), repeat=int(n)),
            key=lambda y: sum(score[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False)),
            default=(),
        )
        assert labels[at : at + n].tolist() == list(best)
        at += n


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    xs = [rng.normal(size=(n, len(line_crf.FEATURES))) for n in (1, 3, 4)]
    ys = [rng.integers(0, 2, len(x)) for x in xs]

    def likelihood(field):
        total = 0.0
        for x, y in zip(xs, ys, strict=True):
            score = x @ field.emit
            paths = list(itertools.product((0, 1), repeat=len(x)))
            value = [sum(score[i, k] for i, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
            total += value[paths.index(tuple(y.tolist()))] - np.logaddexp.reduce(value)
        return total

    fitted = line_crf.train(xs, ys, rounds=300, ridge=0.0)
    assert likelihood(fitted) > likelihood(line_crf.Field(np.zeros_like(fitted.emit), np.zeros((2, 2)))) / 2


def test_held_out_accuracy(make, field):
    rng = random.Random(77)
    rows = [(i, junk(rng, 4) if i % 2 else prose(rng, 6)) for i in range(100)]
    kept = {r["doc_id"] for r in line_crf.judge(make(rows), field).filter("kept").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}
    mixed = prose(rng, 6) + "\n" + junk(rng, 1)
    documents = make([(1, mixed), (2, junk(rng, 5) + "\n" + prose(rng, 1))])
    out = line_crf.keep_content(documents, field)
    assert [r["doc_id"] for r in out.collect()] == [1] and out.columns == documents.columns


def test_no_labels(spark, make, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = line_crf.fit(make([(1, "a b c d e f g h i j k")]), none)
    assert line_crf.judge(make([(1, "a b c d e f g h i j k")]), field).first()["kept"]
    assert line_crf.judge(nothing, field).count() == 0


# --- line dedup ---------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_brute(rows, min_words=5):
    lines = [(order(i), k, WORDS.findall(line)) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        kept = []
        for k, line in enumerate(t.split("\n")):
            w = WORDS.findall(line)
            both = lambda v: w == v or (min(len(w), len(v)) >= min_words and near(w, v))  # noqa: E731, B023
            earlier = bool(w) and any((d, m) < (order(i), k) and both(v) for d, m, v in lines)
            if not earlier:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=lambda r: (order(r[0]), r[1] is not None, r[1] or ""))


def edited(rng, line):
    w = line.split(" ")
    k = rng.randrange(len(w))
    kind = rng.random()
    if kind < 0.4:
        w[k] = rng.choice(VOCABULARY)
    elif kind < 0.7:
        w.insert(k, rng.choice(VOCABULARY))
    elif kind < 0.95 and len(w) > 1:
        del w[k]
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(make, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(3, 9))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(pool)) if rng.random() < 0.6 else rng.choice(pool) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(lines)))
    rows += [(4, rows[4][1]), (5, "other text of the same id here"), (None, pool[0]), (70, None), (71, ""), (72, "  " + pool[1] + "\t")]
    documents = make(rows)
    out = line_dedup.dedup_lines(documents)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda r: (order(r[0]), r[1] is not None, r[1] or ""))
    assert got == dedup_brute(rows)
    assert out.columns == documents.columns and out.first()["h"] == "own h"


def test_line_dedup_odd(odd, nothing):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(odd).select("doc_id", "text").collect()
    assert sorted(((r[0], r[1]) for r in got), key=lambda r: (order(r[0]), r[1] is not None, r[1] or "")) == dedup_brute(rows)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_halves_are_shared_by_all_near_lines(spark):
    pairs = []
    rng = random.Random(9)
    for n in range(5, 12):
        base = [rng.choice(VOCABULARY) for _ in range(n)]
        for k in range(n):
            pairs.append((base, base[:k] + ["other"] + base[k + 1 :]))
            pairs.append((base, base[:k] + base[k + 1 :]))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    keys = [F.array(*line_dedup.halves(F.col(c), F.size(c))) for c in "ab"]
    assert df.filter(~F.arrays_overlap(*keys)).count() == 0
    assert df.filter(~line_dedup.within_one(F.col("a"), F.col("b"))).count() == 0
    far = spark.createDataFrame([(list("abcde"), list("abxyz")), (list("abcde"), list("abc"))], "a array<string>, b array<string>")
    assert far.filter(line_dedup.within_one(F.col("a"), F.col("b"))).count() == 0


def test_line_dedup_runs_no_python(odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- near duplicates ----------------------------------------------------------------------------------------


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lowered)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(values, radius=3):
    """The least index reachable from each."""
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(range(len(values)), 2):
        if (values[x] ^ values[y]).bit_count() <= radius:
            a, b = find(x), find(y)
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(values))]


def test_masks_meet_within_the_radius():
    for radius in (1, 2, 3):
        tables = simhash.masks(radius)
        rng = random.Random(radius)
        for _ in range(3000):
            differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            hit = [m for m in tables if not m & differing]
            assert hit
            assert all(any(not b & differing for b in simhash.blocks(m, radius)) for m in hit)
        for m in tables:
            assert sum(simhash.blocks(m, radius)) | m == (1 << 64) - 1


def test_fingerprints_across_chunks():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(60)] + [None, "", "A b", "Ä É x y"]
    got = simhash.fingerprints_of(pa.array(texts), 3)
    assert got.tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_classes(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {0, *centres}
    for c in centres:
        for _ in range(25):
            v = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values, key=simhash.signed)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in simhash.near_classes(rows, 3, bucket_rows).collect()}
    want = {simhash.signed(v): simhash.signed(values[r]) for v, r in zip(values, roots(values), strict=True)}
    assert {k: got.get(k, k) for k in want} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(5, 5), (400, 401), (401, 400)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in up} == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(rng):
    rows = []
    for i in range(60):
        if i > 5 and rng.random() < 0.4:
            text = rng.choice(rows)[1]
            if text and rng.random() < 0.6:
                text = text.replace(rng.choice(text.split()), "changed", 1)
        else:
            text = prose(rng, rng.randint(0, 12))
        rows.append((i, text))
    return rows


def test_near_duplicates(make, odd, nothing):
    rng = random.Random(12)
    cases = [make(near_rows(rng)), odd]
    for documents in cases:
        rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
        values = [fingerprint(t) for _, t in rows]
        own = roots(values)
        least = {}
        for (i, _), r in zip(rows, own, strict=True):
            if i is not None:
                least[r] = min(least.get(r, i), i)
        want = sorted((order(i), f"{v:016x}", order(least.get(r))) for (i, _), v, r in zip(rows, values, own, strict=True))
        got = simhash.near_duplicates(documents).collect()
        assert sorted((order(r["doc_id"]), r["fingerprint"], order(r["component_id"])) for r in got) == want
        kept = simhash.keep_one(documents)
        assert kept.columns == documents.columns
        alone = {r for r in own if r not in least}
        assert sorted(order(r["doc_id"]) for r in kept.collect()) == sorted([order(i) for i in least.values()] + [order(None)] * len(alone))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


# --- repeated passages --------------------------------------------------------------------------------------


def repeats_brute(rows, window=13):
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {
            k + j for k in range(len(w) - window + 1) for j in range(window) if i is not None and first[tuple(w[k : k + window])] < i
        }
        out.append((order(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"bucket_chars": 500, "batch_bytes": 700}, {"window": 5, "bucket_chars": 300}])
def test_repeated_passages(make, odd, settings):
    rng = random.Random(21)
    passages = [prose(rng, 3, 17) for _ in range(5)]
    rows = [(i, " ".join([prose(rng, 1, rng.randint(0, 40)), rng.choice([*passages, ""]), prose(rng, 1, 9)])) for i in range(50)]
    rows += [(7, rows[7][1]), (9, passages[0]), (None, passages[1]), (80, None), (81, "")]
    for documents in (make(rows), odd):
        held = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
        got = windows.remove_repeats(documents, **settings).collect()
        assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == repeats_brute(
            held, settings.get("window", 13)
        )
        assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
        assert all(a["stop"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_no_passages(nothing, make):
    assert windows.remove_repeats(nothing).count() == 0
    assert windows.remove_repeats(make([(1, "few words"), (2, None)])).count() == 2


def test_entries_round_trip():
    docs, keys = np.array([-5, -5, 3, 2**40]), np.array([1, 2**56 - 1, 7, 0], np.uint64)
    got = windows.unpack_entries(windows.pack_entries(docs, keys))
    assert got[0].tolist() == docs.tolist() and got[1].tolist() == keys.tolist()


def test_clashing_names_are_in_the_fixture(odd):
    assert set(CLASHING) < set(odd.columns)

"""Nearest neighbours, pseudonyms and co-training."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from iocweave.llm import ann, cotrain, pii
from tests.llm.helpers import prose

KEY = b"test key"

# --- nearest neighbours -------------------------------------------------------------------------------------


def exact(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % every == 0:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in usable if j != i and len(w) == len(v))
            out[i] = far[:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    # A third of all rows are one vector; more of them than fit a result.
    rows += [(i, rows[3][1]) for i in range(1500, 2200)]
    rows += [(2300, None), (2400, []), (2500, [0.0] * 16), (2600, [float("nan")] + [1.0] * 15), (2700, [None] + [1.0] * 15), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("shard", "score", "rank", "ids", "n")})
    settings = ann.Settings(shard_rows=400, degree=16, beam=32, search_beam=48, query_rows=5)
    got = {}
    for r in ann.nearest(df, settings=settings).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = exact(rows, 100, 10)
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[i]) + 1))
        assert [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        hits += len({v for _, _, v in found} & {v for _, v in want[i]})
    assert hits >= 0.95 * sum(map(len, want.values()))
    # Ties among copies go to the smaller id.
    assert [v for _, _, v in got[1600]] == [3, *range(1500, 1509)]


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0]), (200, [4.0, 4.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 200, 13**0.5), (200, 1, 1, (9 + 2.25) ** 0.5), (200, 2, 0, 13**0.5)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty).count() == 0


def test_prune_keeps_diverse_neighbours():
    vectors = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3], [5, 5]], np.float32)
    out = ann.robust_prune(vectors, np.array([0]), np.array([[1, 2, 3, 4, 1, 0, -1]]), 3, 1.0)
    # 2 lies behind 1, and 4 is nearer to 3 than to the node.
    assert out.tolist() == [[1, 3, -1]]


# --- pseudonyms ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000, 10**6])
def test_permutation(n):
    spots = range(min(n, 400))
    got = [pii.permute(x, n, KEY, b"t") for x in spots]
    assert len(set(got)) == len(got) and all(0 <= y < n for y in got)
    assert [pii.restore(y, n, KEY, b"t") for y in got] == list(spots)
    assert n < 10 or got != [pii.permute(x, n, b"other key", b"t") for x in spots]


CARD, IBAN = "4539 1488 0343 6467", "DE89 3704 0044 0532 0130 00"


def test_formats_and_links():
    text = (
        f"Card {CARD} or 4539148803436467, IBAN {IBAN}, call +1 (974) 555-3436 or 974-555-3436, born 1984-02-29 = 29.02.1984 = 02/29/1984, "
        "ssn 078-05-1120, host 97.51.17.173, mail Was.26@mail6.example.com; token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""
    )
    new, counts = pii.pseudonymise(text, KEY)
    assert dict(counts) == {"card": 2, "iban": 1, "phone": 2, "date": 3, "ssn": 1, "ip": 1, "email": 1, "secret": 1}
    shape = lambda t: re.sub(r"(?<=host )[\d.]+", "IP", re.sub("[0-9a-f]{40}", "H" * 40, t))
    assert re.sub("[0-9]", "9", shape(new)).replace(new.split("mail ")[1].split("@")[0], "") == re.sub("[0-9]", "9", shape(text)).replace(
        "Was.26", ""
    ) or len(shape(new)) == len(shape(text))
    spaced, plain = re.search(r"Card ([\d ]{19}) or (\d{16})", new).groups()
    assert spaced.replace(" ", "") == plain and plain != CARD.replace(" ", "") and pii.luhn_ok(plain)
    iban = re.search(r"IBAN (DE[\d ]+),", new)[1].replace(" ", "")
    assert pii._iban_value(iban[4:] + iban[:4]) % 97 == 1 and len(iban) == 22
    one, two = re.search(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", new).groups()[0::2]
    assert two.startswith(one)
    iso, dotted, slashed = re.search(r"born (\S+) = (\S+) = (\S+),", new).groups()
    y, m, d = iso.split("-")
    assert dotted == f"{d}.{m}.{y}" and slashed == f"{m}/{d}/{y}"
    assert max(map(int, re.search(r"host (\S+),", new)[1].split("."))) < 256
    assert re.search(r"mail [A-Z][a-z]{2}\.\d\d@mail6\.example\.com", new) and "Was.26" not in new
    assert pii.pseudonymise(new, KEY, pii.restore)[0] == text


def test_invalid_values_stay():
    for text in ("4539 1488 0343 6468", "DE88 3704 0044 0532 0130 00", "2023-02-30", "999.1.2.3", "000-12-3456", "version 3.0, 4.0.1", "12345", "a@b"):
        assert pii.pseudonymise(text, KEY)[0] == text
    # A number beside another one is still found.
    assert "4539148803436467" not in pii.pseudonymise("4539148803436467 12 apples", KEY)[0]


def test_replace_private(odd, nothing, make):
    out = pii.replace_private(odd, KEY)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sorted(str(r["text"]) for r in out.select("text").collect()) == sorted(str(r["text"]) for r in odd.select("text").collect())
    assert pii.replace_private(nothing, KEY).count() == 0
    rows = make([(1, "mail a.b1@x.org"), (2, "again a.b1@x.org"), (2, "again a.b1@x.org")])
    got = [r["text"].split()[-1] for r in pii.replace_private(rows, KEY).collect()]
    assert len(set(got)) == 1 and got[0] != "a.b1@x.org"
    counts = rows.select(pii.pseudonyms(F.col("text"), KEY).alias("r")).select("r.*").collect()
    assert [c["n_email"] for c in counts] == [1, 1, 1] and all(c["n_card"] == 0 for c in counts)


# --- co-training --------------------------------------------------------------------------------------------


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(2, 8)) if good else "\n".join("buy ### now $$$ " * 6 for _ in range(rng.randint(1, 4)))
        source = rng.choice(["a", "b", "c"] if good == (rng.random() < 0.85) else ["x", "y"])
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df, labels


def test_cotraining_held_out(spark):
    df, labels = labelled(spark, 900, 3)
    known = spark.createDataFrame(labels[:150] + [(None, 1), (3, None), (10**6, 0)], "doc_id long, quality int")
    df = df.withColumns({c: F.lit("own") for c in ("content", "meta", "score", "kept", "label", "y")})
    out = {r["doc_id"]: r for r in cotrain.classify(df, known, sample=120, exchange=60).collect()}
    rest = labels[150:]
    assert len(out) == 900
    assert np.mean([out[i]["kept"] == bool(y) for i, y in rest]) > 0.97
    # The metadata view alone is right far more often than chance, and scores are probabilities.
    assert np.mean([(out[i]["meta_score"] > 0.5) == bool(y) for i, y in rest]) > 0.75
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_cotraining_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (8, 0)], "doc_id long, quality int")
    assert cotrain.classify(odd, labels).count() == odd.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in cotrain.classify(odd, none).collect()} == {0.5}
    assert cotrain.classify(nothing, labels).count() == 0


def test_content_view_across_chunks():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 500)) for _ in range(150)] + [None, ""]
    together = cotrain.content_view(pa.array(texts))
    assert np.allclose(together, np.concatenate([cotrain.content_view(pa.array([t], pa.string())) for t in texts]))

"""Spelling groups, resampling and web archives against plain versions over whole small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iocweave.llm import resample, spelling, warc
from iocweave.llm.queries import QUERIES
from iocweave.session import work_dir
from tests.llm.helpers import CLASHING

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- spelling ------------------------------------------------------------------------------------------------

def plain_words(rows, slip=31):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, factor=10):
    near = defaultdict(set)
    cut = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            cut[w[:i] + "\0" + w[i + 1 :]].add(w)  # replaced at i
            cut[w[:i] + w[i + 1 :]].add(w)
        cut[w].add(w)
    for group in cut.values():
        for a in group:
            near[a].update(b for b in group if a != b and one_edit(a, b))
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[w] = [form, n, len(near[w])]
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = plain_words(rows)
    assert as_set(QUERIES["op11_spelling"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n")) == plain_groups(counts)


def test_counted_words_odd(odd, nothing, make):
    rows = odd.select("doc_id", "text").collect()
    assert as_set(spelling.counted_words(odd)) == set(plain_words(rows).items())
    # Every occurrence in a text of many words, upper case and letters beyond ASCII among them.
    rng = random.Random(3)
    texts = [(i % 5 if i % 7 else None, " ".join(rng.choice(["Ähnlichkeit", "STRASSENBAHN", "maßnahme", "ÀÉÎabcdef", "wordword"]) for _ in range(300))) for i in range(40)]
    assert as_set(spelling.counted_words(make(texts))) == set(plain_words(texts).items())
    assert spelling.spelling_groups(spelling.counted_words(nothing)).collect() == []


@pytest.mark.parametrize("block", [3, 1024])
def test_groups_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(5)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdeö𝒳") for _ in range(rng.randint(1, 9)))
        counts[word] = 10 ** rng.randint(0, 5)
        for _ in range(6):
            i = rng.randrange(len(word) + 1)
            other = rng.choice([word[:i] + rng.choice("abcé") + word[i:], word[:i] + word[i + 1 :], word[:i] + "e" + word[i + 1 :], word[::-1]])
            counts.setdefault(other, 10 ** rng.randint(0, 5))
    counts["x" * 5000], counts["x" * 4999 + "y"] = 1, 100
    counts.pop("", None)
    df = spark.createDataFrame([*counts.items(), (None, 3), ("", 4)], "word string, n long").withColumns({c: F.lit(1) for c in ("cell", "block", "near")})
    assert as_set(spelling.spelling_groups(df)) == plain_groups(counts)


def test_chain_of_forms(spark):
    chain = [("aaaaaaaa"[:k] + "b" * (8 - k), 10**k) for k in range(9)]
    got = {r["word"]: r["root"] for r in spelling.spelling_groups(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaaaa"} and len(got) == 9


def test_pairs_within_a_block():
    i, j = spelling.near_in_blocks(["abcd", "abce", "dcba", "abcd"[::-1]], None)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1)]
    i, j = spelling.near_in_blocks(["abcd", "aabc"], ["abc", "bcd", "aab"])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(0, 0), (0, 1), (1, 0), (1, 2)}


# --- resampling ----------------------------------------------------------------------------------------------

def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resample(docs, bench, percent=5, min_words=20):
    features = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in features for b in f), Counter(b for (x,) in bench for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for (doc, _), (n, f) in zip(docs, features, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = [(*r, i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    rest = able[len(drawn) :] + [r for r in rows if r[1] < min_words]
    return Counter(drawn + [(*r, None) for r in rest])


def test_resample_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    want = Counter({(r[0], *r[2:]): n for r, n in plain_resample(docs, bench).items()})
    got = Counter(tuple(r) for r in QUERIES["op12_resample"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == want


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_resample_odd(spark, odd, nothing, make, monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    rng = random.Random(1)
    words = ["Alpha", "beta", "ß", "日本", "x" * 70, "gamma9"]
    more = make([(i // 3, " -".join(rng.choice(words) for _ in range(rng.randint(15, 400)))) for i in range(60)])
    docs = odd.unionByName(more)
    target = spark.createDataFrame([("alpha beta",), (None,), ("gamma9 " * 30,)], "text string").withColumns({c: F.lit(2) for c in CLASHING})
    want = plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in target.select("text").collect()], 50)
    assert Counter(tuple(r) for r in resample.resample(docs, target, 50).collect()) == want
    assert resample.resample(nothing, target).collect() == []
    assert resample.resample(docs, target.limit(0)).filter("rank IS NOT NULL").count() == plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], []).total() * 0 + sum(
        1 for r in plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], []) if r[5] is not None
    )


@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(-9_000, 9_000)), min_size=1, max_size=150))
@settings(max_examples=50, deadline=None)
def test_bit_planes_are_exact(pairs):
    counts, gain = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert resample.Weigher(gain)(counts[None, :]).tolist() == [int((counts * gain).sum())]


@given(st.lists(st.text("aé9 Z.日", max_size=200), max_size=5))
@settings(max_examples=50, deadline=None)
def test_buckets_of_runs(texts):
    counts, codes, words = resample.feature_words(pa.array(texts, pa.string()))
    buckets, owner = resample.feature_buckets(counts, codes, words)
    for i, text in enumerate(texts):
        assert Counter(buckets[owner == i].tolist()) == Counter(plain_features(text)[1])


# --- web archives --------------------------------------------------------------------------------------------

def plain_records(pages, least=0):
    last = {}
    for page, _, html in pages:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            last[body] = max(last.get(body, page), page)
    out = Counter()
    for page, _, html in pages:
        body = (html or "").encode()
        top = last.get(body) if len(body) >= least else None
        refers = top if top is not None and top != page else None
        out[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers] += 1
    return out


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = QUERIES["op13_warc"](spark, SF).collect()
    assert Counter(tuple(r[c] for c in FIELDS) for r in rows) == plain_records(pages)


ODD_PAGES = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/y?q#f", "<p>same</p>"), (2, "http://b.example/y?q#f", "<p>same</p>"),
    (None, None, "<p>same</p>"), (3, None, None), (4, "HTTP://user@WWW.A.example:80", ""), (5, "http://x y\r\nz", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n"),
    (6, "http://a.example/x", "é\u0000日本\n" * 5000), (None, "http://a.example/x", "alone"), (None, "http://a.example/x", "alone"), (-7, "", "\r\n\r\n"),
    (8, "http://b.example/" + "p" * 9000, "x" * 300_000), (9, "no scheme", "\r\n"), (10, "http://%0A/", "HTTP/1.1 200 OK\r\n\r\n"),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_odd(spark, compression):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("payload", "time", "value", "_n", "run")})
    when = F.when(F.col("page_id") != 3, F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") % 3))
    for least in (0, 5):
        path = work_dir(spark, "archives")
        boundary = warc.write_archives(pages, path, when, least, compression)
        records = warc.read_archives(spark, path, boundary)
        rows = records.collect()
        assert Counter(tuple(r[c] for c in FIELDS) for r in rows) == plain_records(ODD_PAGES, least)
        bodies = Counter(r["payload"] for r in rows if r["record_type"] == "response")
        assert set(bodies) == {h or "" for _, _, h in ODD_PAGES}
        index = warc.capture_index(records).collect()
        keys = [(r["url_key"], r["time"] is not None, r["time"], r["page_id"] is not None, r["page_id"]) for r in index]
        assert [k[:2] for k in keys] == sorted(k[:2] for k in keys)
        assert Counter(tuple(r[c] for c in FIELDS) for r in index) == plain_records(ODD_PAGES, least)
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[5] == "http://x%20y%0D%0Az" and urls[3] is None and urls[10] == "http://%0A/"


def test_archives_are_plain_warc(spark):
    """Records can be walked by their lengths alone, as other readers do."""
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").coalesce(1)
    path = work_dir(spark, "archives")
    warc.write_archives(pages, path, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    raw = b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect())
    seen = 0
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw, seen = rest[size + 4 :], seen + 1
    assert seen == len(ODD_PAGES)


def test_warc_splits_and_ranges(spark, monkeypatch):
    """Files read in small splits, many runs and ranges: nothing is lost, and the order is global."""
    monkeypatch.setattr(warc, "RUN_ROWS", 40)
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    rng = random.Random(2)
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{rng.randrange(40)}.example/{rng.randrange(9)}", "z" * rng.randrange(900) + "\r\n\r\nWARC/1.1\r\n") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = work_dir(spark, "archives")
    boundary = warc.write_archives(pages, path, F.timestamp_seconds(F.lit(1700000000) - F.col("page_id")))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = warc.read_archives(spark, path, boundary)
        assert records.rdd.getNumPartitions() > 20
        index = warc.capture_index(records.drop("payload"))
        got = index.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert index.rdd.getNumPartitions() >= 9
    order = [(r["url_key"], r["time"], r["page_id"]) for r in got]
    assert order == sorted(order) and Counter(tuple(r[c] for c in FIELDS) for r in got) == plain_records(rows)
    hot = warc.capture_histories(index).filter("url_key = 'example,hot)/'").first()
    assert hot["captures"] == 600


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = work_dir(spark, "archives")
    boundary = warc.write_archives(pages, path, F.current_timestamp())
    assert warc.capture_index(warc.read_archives(spark, path, boundary)).collect() == []


@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(sorted), max_size=9))
@settings(max_examples=80, deadline=None)
def test_loser_tree(runs):
    got = [(runs[r][i], r) for r, i in warc.LoserTree(runs)]
    assert got == sorted((v, r) for r, run in enumerate(runs) for v in run)

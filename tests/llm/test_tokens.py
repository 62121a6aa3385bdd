"""Token files, packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from iocweave.llm import bpe, packing, token_files
from iocweave.session import work_dir
from tests.llm.helpers import ODD_TEXTS, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.fixture(scope="module")
def words(library):
    return lambda t: library[WORD].encode(t or "", add_special_tokens=False).ids + [2]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@given(st.lists(st.integers(0, 2**60 - 1) | st.integers(0, 3) | st.just(0) | st.integers(2**60, 2**64 - 1) | st.just(1 << 60), max_size=700))
@settings(max_examples=60, deadline=None)
def test_block_round_trip(ids):
    payload = token_files.write_block([len(ids)], np.array(ids, np.uint64))
    lengths, got = token_files.read_block(payload)
    assert lengths.tolist() == [len(ids)] and got.tolist() == ids
    a, b = len(ids) // 3, 2 * len(ids) // 3
    assert token_files.read_block(payload, a, b)[1].tolist() == ids[a:b]


def test_zeros_take_few_words():
    assert len(token_files.pack(np.zeros(480, np.uint64))) == 2


def test_escaped_ids():
    """Ids beyond 60 bits, also some that look like escapes, wherever strides begin."""
    for shift in range(4):
        ids = [1] * shift + [2**64 - 1, 1, 2**60 + 1] * 600 + [0] * 500
        payload = token_files.write_block([len(ids)], np.array(ids, np.uint64))
        for a in range(0, len(ids), 97):
            assert token_files.read_block(payload, a, a + 300)[1].tolist() == ids[a : a + 300]
    assert token_files.pack(np.array([5, 2**63, 5], np.uint64)).tolist()[1:3] == [1, 2**63]


def test_token_files(spark, odd, nothing, words):
    for documents in (odd, nothing):
        path = work_dir(spark, "tokens")
        token_files.encode_to_files(documents, path, WORD, block_ids=500)
        rows = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r["start"])
        want = sorted(documents.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]
        at = 0
        for row, (_, text) in zip(rows, want, strict=True):
            assert row["start"] == at and row["ids"] == words(text)
            at += len(row["ids"])
        digests = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_files(spark, path, digests=True).collect()}
        assert digests == {(r["start"], len(r["ids"]), zlib.crc32(raw(r["ids"]))) for r in rows}


def test_price_is_the_best_pattern():
    sizes, duals = np.array([3, 4, 7]), np.array([0.31, 0.44, 0.75])
    best, counts = packing.price(duals, sizes, 16)
    brute = max(
        (a * 0.31 + b * 0.44 + c * 0.75) for a in range(6) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 16
    )
    assert best == pytest.approx(brute) and counts @ duals == pytest.approx(brute) and counts @ sizes <= 16


@pytest.mark.parametrize("seed", range(5))
def test_cutting_stock_covers_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    plan = packing.cutting_stock(histogram, 64)
    covered = defaultdict(int)
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64 and times > 0
        for s, n in pattern.items():
            covered[s] += n * times
    assert dict(covered) == histogram
    # No packing can be below the volume, nor below one sequence for each piece over half.
    least = max(-(-sum(s * n for s, n in histogram.items()) // 64), sum(n for s, n in histogram.items() if s > 32))
    assert sum(times for _, times in plan) <= least * 1.01 + 2
    assert packing.cutting_stock({}, 64) == []


def check_packed(rows, texts, words, size):
    """Every id in one piece, pieces gapless in documents and sequences; ``texts`` are those of each doc_id."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for name, held in texts.items():
        want = sorted(
            (a, len(ids[a : a + size]), zlib.crc32(raw(ids[a : a + size])), len(ids))
            for ids in map(words, held) for a in range(0, len(ids), size)
        )
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in documents[name])
        assert got == want
    assert set(documents) == set(texts)
    return len(sequences)


def test_packing(odd, nothing, words):
    for documents in (odd, nothing):
        texts = defaultdict(list)
        for r in documents.select("doc_id", "text").collect():
            texts[r[0]].append(r[1])
        check_packed(packing.pack(documents, WORD, size=256, unit=8).collect(), texts, words, 256)
    row = packing.pack(odd.filter("doc_id = 4"), WORD, with_ids=True).first()
    assert row["ids"] == words("one") and row["offset"] == 0


def test_packing_has_little_padding(make, words):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 30))) for i in range(400)]
    out = packing.pack(make(rows), WORD, size=1024).collect()
    n = check_packed(out, {i: [t] for i, t in rows}, words, 1024)
    assert sum(r["length"] for r in out) / (1024 * n) > 0.97


def assert_bpe(texts, library):
    model = bpe.model(BYTE)
    ids = model.encode(pa.array(texts, pa.string()))
    for text, got, back in zip(texts, ids.to_pylist(), model.decode(ids).to_pylist(), strict=True):
        want = library[BYTE].encode(text or "", add_special_tokens=False).ids
        assert got == want and back == library[BYTE].decode(want, skip_special_tokens=False)


def test_bpe_odd_texts(library):
    assert_bpe([*ODD_TEXTS, "a \n\n b", "x  \n y\n  z ", "a\x1cb\x85c", "<|endoftext|><|endoftext|>", "<|endoftext"], library)


@given(st.lists(st.text(alphabet=st.sampled_from("abeinrst \n\t'.,!<|>éß1日 "), max_size=40), max_size=20))
@settings(max_examples=40, deadline=None)
def test_bpe_any_text(library, texts):
    assert_bpe(texts, library)


def test_compatible_pairs_are_those_that_stand():
    model = bpe.model(BYTE)
    rng = np.random.default_rng(3)
    usable = np.array(list(model.usable.values()))
    a, b = rng.choice(usable, 3000), rng.choice(usable, 3000)
    want = [model.merge(model.bytes_of[x] + model.bytes_of[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert model.compatible(a, b).tolist() == want


def test_round_trip(odd, nothing, library):
    rows = bpe.round_trip(odd, BYTE).collect()
    texts = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in odd.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["decoded"]) for r in rows) == texts
    assert bpe.round_trip(nothing, BYTE).count() == 0
    digest = {hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in rows}
    assert len(digest) == len({r["decoded"] for r in rows})


def test_decode_of_ids_that_are_no_text():
    model = bpe.model(BYTE)
    half = model.encode(pa.array(["é"]))[0].as_py()
    assert model.decode(pa.array([[model.single[0xC3]], None, [], [10**6], half], pa.list_(pa.int32()))).to_pylist() == ["�", None, "", "", "é"]

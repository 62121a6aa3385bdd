"""The pipeline and its stages against brute force, and what must hold without the subpackage."""

import collections
import random
import re
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from iocweave.llm import line_crf, pii
from iocweave.llm.queries import DEMO_KEY
from tests.llm.helpers import prose
from tests.llm.test_documents import dedup_brute, fingerprint, junk, roots
from tests.llm.test_tokens import check_packed


def tables(spark, make, folder):
    rng = random.Random(31)
    rows = []
    for i in range(80):
        text = junk(rng, 5) if i % 7 == 0 else prose(rng, rng.randint(3, 8))
        if i % 5 == 1:
            text += f"\nWrite to name{i}@mail.example.com or call +1 (974) 555-34{i:02d} about it."
        if i > 20 and i % 6 == 0:
            text = rows[i - 15][1]
        rows.append((i, text))
    make(rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 7 != 0)) for i in range(0, 80, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, make, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, make, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.dtypes == docs.dtypes
            got = sorted((r["doc_id"], r["text"]) for r in after.collect())
        if k == 0:
            field = line_crf.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            kept = {r["doc_id"] for r in line_crf.judge(docs, field).filter("kept").collect()}
            held = [r for r in held if r[0] in kept]
            assert kept >= {i for i, t in rows if "###" not in t and "$$$" not in t} and len(kept) < len(rows)
        elif k == 1:
            held = dedup_brute(held)
        elif k == 2:
            own = roots([fingerprint(t) for _, t in held])
            held = [held[i] for i in sorted(set(own))]
        elif k == 3:
            held = [(i, pii.pseudonymise(t, DEMO_KEY)[0]) for i, t in held]
            assert not any(re.search(r"name\d+@", t) for _, t in held)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            texts = collections.defaultdict(list)
            for i, t in held:
                texts[i].append(t)
            check_packed(after.collect(), texts, lambda t: library.encode(t, add_special_tokens=False).ids + [2], 4096)
            continue
        assert got == sorted(held), name
        docs = after
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in after.collect())


def test_stages_on_odd_documents(spark, odd, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(3, 0), (4, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    for documents in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, documents, folder)
            assert out.count() <= max(documents.count(), 1) * 3
            if name != "packing":
                assert out.columns == documents.columns


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent
    users = {
        str(p.relative_to(root)) for p in root.rglob("*.py") if re.search(r"iocweave\.llm|from iocweave import llm|corpus_pipeline", p.read_text())
    }
    assert {u for u in users if not u.startswith(("iocweave/llm/", "tests/llm/"))} == {"__spark_entry__.py", "corpus_pipeline.py"}

"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave.llm import (
    ann, bpe, cotrain, line_crf, line_dedup, packing, pii, resample, simhash, spelling, token_files, warc, windows,
)
from iocweave.llm.common import prepare, table
from iocweave.session import work_dir

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
#: A fixed key, so that runs agree. Real runs pass a secret one.
DEMO_KEY = b"replace this key"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(prepare(spark), "tokens")
    token_files.encode_to_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_files.read_files(spark, path, digests=True)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_crf.judge(documents, line_crf.fit(documents, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", pii.pseudonyms(F.col("text"), DEMO_KEY).alias("_r"))
    return rows.select("doc_id", "_r.*")


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.counted_words(table(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), work_dir(prepare(spark), "archives")
    # The table holds no time of capture: pages were fetched one a second, in the order of their numbers.
    time = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)))
    boundary = warc.write_archives(pages, path, time)
    index = warc.capture_index(warc.read_archives(spark, path, boundary).drop("payload"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest, op2_token_files, op3_line_crf, op4_packing, op5_simhash, op6_pseudonyms, op7_speculative_bpe,
        op8_cotraining, op9_windows, op10_line_dedup, op11_spelling, op12_resample, op13_warc,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op9_windows": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (s) WHERE first.least < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
    SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
    # The deletion neighbourhood with the words themselves as keys.
    "op10_line_dedup": f"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents
),
lw AS (SELECT *, {_WORDS.format('line')} AS w FROM l),
p AS (SELECT w, min((doc_id, line_no)) AS pos FROM lw WHERE len(w) > 0 GROUP BY w),
v AS (
    SELECT pos, len(w) AS n, -1 AS gap, array_to_string(w, ' ') AS s FROM p WHERE len(w) >= 5
    UNION ALL
    SELECT pos, len(w), i, array_to_string(w[:i - 1] || w[i + 1:], ' ')
    FROM (SELECT pos, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) >= 5)
),
same AS (SELECT s, gap, min(pos) AS least FROM v WHERE gap > 0 GROUP BY s, gap HAVING count(*) > 1),
whole AS (SELECT s, min(pos) FILTER (gap < 0) AS full_pos, min(pos) FILTER (gap > 0) AS cut_pos FROM v GROUP BY s),
near AS (
    SELECT v.pos FROM v JOIN same USING (s, gap) WHERE least < v.pos
    UNION
    SELECT v.pos FROM v JOIN whole USING (s) WHERE gap > 0 AND full_pos < v.pos
    UNION
    SELECT v.pos FROM v JOIN whole USING (s) WHERE gap < 0 AND cut_pos < v.pos
),
judged AS (
    SELECT lw.doc_id, lw.line_no, lw.line,
        p.pos IS NOT NULL AND ((lw.doc_id, lw.line_no) > p.pos OR near.pos IS NOT NULL) AS gone
    FROM lw LEFT JOIN p USING (w) LEFT JOIN near ON near.pos = p.pos
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
FROM judged GROUP BY doc_id
""",
}

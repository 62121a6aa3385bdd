"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words; two lines are near if one word was replaced, added or taken away. The deletion neighbourhood of a
line has the line and every line with one word less, each as a hashed key: near lines share a key. Sending all of
them would send the corpus once per word, so lines first have to share a half with another line: one edit leaves the
first or the last half of the shorter line as it was, and three hashes per line cover every way to halve it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import same_columns, written
from iocweave.functions.base import let
from iocweave.operators.match import skew_join

SPACE = "[\\x20\\x09-\\x0D]+"
LINES_PER_TEXT = 1 << 31


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def without(items: Column, i: Column) -> Column:
    """The array without its element at ``i``, from 0."""
    return F.concat(F.slice(items, 1, i), F.slice(items, i + 2, F.size(items)))


def halves(items: Column, n: Column) -> list[Column]:
    """Three keys, of which near lines have one in common.

    A line of n words has first parts of n//2 and (n-1)//2 words and the last parts that go with them; for one of the
    two the sizes agree, so three differ.
    """
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    first = F.when(n % 2 == 1, high).otherwise(low)

    def head(size: Column) -> Column:
        return F.xxhash64(F.lit("head"), size, F.slice(items, 1, size))

    def tail(size: Column) -> Column:
        return F.xxhash64(F.lit("tail"), size, F.slice(items, n - size + 1, size))

    # n odd: heads of n//2, tails of n//2 + 1 and n//2. n even: heads of n/2 and n/2 - 1, tail of n/2.
    return [head(high), tail(n - high), F.when(n % 2 == 1, tail(high)).otherwise(head(first))]


def within_one(a: Column, b: Column) -> Column:
    """Whether word lists differ by one replaced, added or missing word at most."""

    def shorter(x: Column, y: Column) -> Column:
        return (F.size(x) == F.size(y) + 1) & F.exists(
            F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), lambda i: without(x, i) == y
        )

    apart = F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z)
    return F.when(F.size(a) == F.size(b), F.size(apart) <= 1).otherwise(shorter(a, b) | shorter(b, a))


#: Stands for a null doc_id, before all others.
NO_ID = str(-(2**63) - 1)


def _position(doc_id: Column, line_no: Column) -> Column:
    """Order of lines as one number: by doc_id, a null one first, then by line."""
    number = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)"))
    return (number * F.lit(LINES_PER_TEXT).cast("decimal(11,0)") + line_no.cast("int")).cast("decimal(38,0)")


def _place(pos: Column) -> tuple[Column, Column]:
    """doc_id (null for none) and line_no of a position."""
    line = F.pmod(pos, F.lit(LINES_PER_TEXT).cast("decimal(38,0)"))
    number = ((pos - line) / F.lit(LINES_PER_TEXT).cast("decimal(11,0)")).cast("decimal(20,0)")
    return F.when(number > F.lit(NO_ID).cast("decimal(20,0)"), number).cast("long"), line.cast("int")


def _more_than_one(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The ``rows`` (a written table) whose key occurs again.

    The keys are a written table with a predicate, so that Spark can filter the scan of the rows by a Bloom filter of
    them, and only rows that meet another one move.
    """
    often = written(rows.groupBy(key).agg(F.count("*").alias("_times")).filter("_times > 1"), name)
    return skew_join(rows, often.filter("_times > 1").select(key), [key])


def removed_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, _text_hash, line_no) of every line of ``documents`` that an equal or near line precedes.

    Lines without a word take no part. Lines of fewer than ``min_words`` words are removed after an equal one only; near
    ones may differ by one word from there on. Order is that of (doc_id, line_no), a null doc_id first;
    lines are judged on the input, not on what is left. Rows that agree in doc_id and text hold the same positions, so
    they lose the same lines.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text is left behind before its lines become rows; what is computed beside a generator is computed for each row.
    split = base.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.split("text", "\n").alias("_lines"))
    exploded = split.select("doc_id", "_text_hash", F.posexplode("_lines").alias("line_no", "_line"))
    listed = exploded.select("doc_id", "_text_hash", "line_no", words(F.col("_line")).alias("_w")).withColumn("n", F.size("_w"))
    k1, k2, k3 = halves(F.col("_w"), F.col("n"))
    long = F.col("n") >= min_words
    lines = written(
        listed.filter(F.col("n") > 0).select(
            "doc_id", "_text_hash", "line_no", F.xxhash64("_w").alias("h"),
            *[F.when(long, k).alias(name) for name, k in (("k1", k1), ("k2", k2), ("k3", k3))],
        ),
        "lines",
    )
    distinct = lines.withColumn("pos", _position(F.col("doc_id"), F.col("line_no"))).groupBy("h").agg(
        F.min("pos").alias("pos"), F.count("*").alias("times"),
        F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("k3").alias("k3"),
    )
    distinct = written(distinct, "distinct-lines")

    # Lines that share a half with another line, and their words.
    keyed = distinct.filter("k1 IS NOT NULL").select("pos", "h", F.explode(F.array("k1", "k2", "k3")).alias("key"))
    keyed = written(keyed, "halves")
    doc, line = _place(F.col("pos"))
    wanted = _more_than_one(keyed, "key", "shared-halves").groupBy("h").agg(F.min("pos").alias("pos"))
    wanted = written(
        wanted.select(doc.alias("_d"), F.struct(line.alias("line_no"), "pos", "h").alias("want"))
        .groupBy("_d").agg(F.collect_list("want").alias("_wanted")).withColumn("_size", F.size("_wanted")),
        "candidates",
    ).filter("_size > 0")
    # Rows without an id are few or none; apart from them the join is on a plain column, which a Bloom filter can use.
    found = base.filter("doc_id IS NOT NULL").join(wanted, F.col("doc_id") == F.col("_d"))
    found = found.unionByName(base.filter("doc_id IS NULL").join(wanted.filter("_d IS NULL"), F.col("doc_id").eqNullSafe(F.col("_d"))))
    # The lines of a text are named once, so that each wanted one is taken from them, and rows carry no other line.
    taken = let(
        F.split("text", "\n"),
        lambda lines: F.transform(
            "_wanted", lambda want: F.struct(want["pos"].alias("pos"), want["h"].alias("h"), F.get(lines, want["line_no"]).alias("_line"))
        ),
    )
    near_lines = found.select(F.inline(taken)).select("pos", "h", words(F.col("_line")).alias("w"))
    # Texts of one doc_id may differ: only the line that was meant has its hash.
    near_lines = written(near_lines.filter(F.col("h") == F.xxhash64("w")).dropDuplicates(["h"]), "near-lines")

    # The deletion neighbourhood: at -1 the whole line, else the place of the word that is left out.
    variants = near_lines.select("pos", "h", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at")).select(
        F.when(F.col("at") < 0, F.col("h")).otherwise(F.xxhash64(without(F.col("w"), F.col("at")))).alias("key"), "at", "pos", "h"
    )
    # Equal variants. Of them only the earliest matters: at the same place (a word replaced), or whole against shortened.
    equal = written(_more_than_one(written(variants, "variants"), "key", "equal-keys"), "equal-variants")
    by_place = equal.filter("at >= 0").groupBy("key", "at").agg(F.min("pos").alias("witness"), F.count("*").alias("_n"))
    replaced = skew_join(equal.filter("at >= 0"), by_place.filter("_n > 1").drop("_n"), ["key", "at"]).select("pos", "h", "witness")
    by_key = equal.groupBy("key").agg(
        F.min(F.when(F.col("at") < 0, F.col("pos"))).alias("_whole"), F.min(F.when(F.col("at") >= 0, F.col("pos"))).alias("_cut")
    ).filter(F.col("_whole").isNotNull() & F.col("_cut").isNotNull())
    moved = skew_join(equal, by_key, ["key"]).select(
        "pos", "h", F.when(F.col("at") < 0, F.col("_cut")).otherwise(F.col("_whole")).alias("witness")
    )
    pairs = replaced.unionByName(moved).filter("witness < pos").select("h", "witness").distinct()
    # Equal keys are not yet equal words: the edit distance decides.
    left = near_lines.select("h", F.col("w").alias("_a"))
    right = near_lines.select(F.col("pos").alias("witness"), F.col("w").alias("_b"))
    near = skew_join(skew_join(pairs, left, ["h"]), right, ["witness"]).filter(within_one(F.col("_a"), F.col("_b")))
    near = near.select("h").distinct().withColumn("_near", F.lit(True))

    judged = distinct.select("h", F.col("pos").alias("_first"), "times").join(near, "h", "left")
    judged = judged.select("h", "_first", (F.col("times") + F.when(F.col("_near"), 1).otherwise(0)).alias("_reasons"), F.col("_near"))
    judged = written(judged.filter("_reasons > 1"), "judged").filter("_reasons > 1")
    all_lines = skew_join(lines.select("doc_id", "_text_hash", "line_no", "h"), judged, ["h"])
    pos = _position(F.col("doc_id"), F.col("line_no"))
    return all_lines.filter(F.col("_near").isNotNull() | (pos > F.col("_first"))).select("doc_id", "_text_hash", "line_no")


def dedup_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """``documents`` with every line removed that an equal or near line precedes (see ``removed_lines``).

    All columns stay, extra ones too; only text changes, and a null text stays null. No row is dropped: a text may
    become empty. Lines without a word stay. A text of many lines is put together in time proportional to them.
    """
    gone = removed_lines(documents, min_words)
    gone = gone.groupBy("doc_id", "_text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("__llm_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__llm_id", "_text_hash": "__llm_hash"})
    marked = documents.withColumn("__llm_key", F.xxhash64(F.col("text").cast("string")))
    same = (F.col("__llm_key") == F.col("__llm_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_id"))
    # A mark for each line up to the last one removed, put together from the gaps between those that go.
    gone_before = lambda i: F.when(i > 0, F.get("__llm_gone", i - 1)).otherwise(F.lit(-1))
    marks = F.flatten(
        F.transform("__llm_gone", lambda line, i: F.concat(F.array_repeat(F.lit(False), line - gone_before(i) - 1), F.array(F.lit(True))))
    )
    lines = F.zip_with(F.split("text", "\n"), marks, lambda line, mark: F.when(~F.coalesce(mark, F.lit(False)), line))
    kept = F.array_join(lines, "\n")
    text = F.when(F.col("__llm_gone").isNull(), F.col("text")).otherwise(kept)
    return marked.join(gone, same, "left").select(*same_columns(documents, text=text))

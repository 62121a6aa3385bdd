"""Web archives: WARC records written by Spark's text writer, read back, and an index of captures by URL and time.

Writing. A record is a row of text, so Spark's own writers, committers and file systems make the archives; they are
plain WARC 1.1 files. Each record carries a boundary, drawn for the archive, in its first header field. Readers part the
files at the boundary, so that files of any size are split over tasks without looking for record lengths in order.
Payloads that occur more than once are written once, as a response; the others become revisit records.

Index. Captures are sorted within each task into runs, which are written. A second job deals the entries to ranges of
(URL key, time), cuts what a range receives into its sorted runs and merges these with a loser tree. The ranges follow
one another, so the result is in global order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave.llm.common import written
from iocweave.operators.match import skew_join

#: Entries of a run, and of a range of the merged index, about.
RUN_ROWS = 50_000
RANGE_ROWS = 200_000

EOL = "\r\n"
BOUNDARY = "WARC-Archive-Boundary"

# Digits of base 32 as Spark counts them, and as RFC 4648 writes them.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: 40 hexadecimal digits are four times ten, and each ten are eight of base 32."""
    hex_digits = F.sha1(payload)
    tens = [F.lpad(F.conv(F.substring(hex_digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*tens), _DIGITS, _BASE32)


def header_value(text: Column) -> Column:
    """A text as a header field can hold it: white space and control characters are percent-encoded."""
    codes = [*range(33), 127]
    out = text
    for c in codes:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), out).otherwise(text)


def url_key(url: Column) -> Column:
    """Sort key of a URL: its host from the top level down, then the rest without scheme, user, ``www.``, default port
    and fragment, in lower case. Captures of one site stand together. A null URL has the empty key."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\d*\.)?", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r":(?:80|443)?$", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(plain == "", "").otherwise(key)


def captures(pages: DataFrame, time: Column, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with what a record needs: payload, its size and digest, time, type, refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is the response (each
    of them, if it occurs in several rows) and the others revisit it. Rows without a page_id are less than all others
    and refer to the largest; if a payload has no page_id at all, all its rows are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), time.alias("time"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    # Only payloads that occur again are joined back, so single ones are never a key; a hot one is split at run time.
    # They are a table of their own, whose size is known before the join is planned: a small one is broadcast, and then
    # no payload moves.
    again = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest").agg(F.count("*").alias("_n"), F.max("page_id").alias("_last"))
        .filter("_n > 1 AND _last IS NOT NULL").select("payload_digest", "_last")
    )
    rows = skew_join(rows, written(again, "repeated"), ["payload_digest"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("_last"))).drop("_last")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record(boundary: str) -> Column:
    """The text of a record, without the two empty lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    page = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(EOL + EOL),
    )
    body = F.when(revisit, page).otherwise(F.concat(page, F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{EOL}{BOUNDARY}: {boundary}{EOL}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        field("WARC-Target-URI", header_value(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response" + EOL),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit(EOL), body,
    )


def write_archives(pages: DataFrame, path: str, time: Column, min_bytes: int = 0, compression: str = "none") -> str:
    """Write a WARC record for every row of ``pages`` under ``path``; the boundary, which readers need, is returned.

    A null html is an empty payload, a null url or ``time`` leaves its field out. Repeated rows give repeated records,
    an empty table an archive without records. Other columns are not read. Text is UTF-8. Archives compressed with gzip
    are read by one task each, plain ones by several.
    """
    boundary = uuid.uuid4().hex
    rows = captures(pages, time, min_bytes).select(record(boundary).alias("value"))
    rows.write.option("lineSep", EOL * 2).option("compression", compression).text(path)
    return boundary


RECORD_COLUMNS = ["page_id", "url", "time", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_archives(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """One row per record: page_id, url (as the archive holds it), time, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for a revisit). Size and digest of a response are those of the payload read; those of
    a revisit, which has none, are taken from its header. A record whose length is not the one it states stops the run.
    """
    first = f"WARC/1.1{EOL}{BOUNDARY}: {boundary}{EOL}"
    # Pieces lie between two boundaries; the first of a file still has its own, the last the lines that end a record.
    pieces = spark.read.option("lineSep", EOL * 2 + first).schema("value string").text(path)
    value = F.when(F.col("value").startswith(first), F.substr("value", F.lit(len(first) + 1))).otherwise(F.col("value"))
    split = F.instr("_record", EOL * 2)
    rows = pieces.select(value.alias("_record")).filter("_record <> ''").select(
        F.concat(F.lit(EOL), F.substring("_record", F.lit(1), split), F.lit("\n")).alias("_head"),
        F.substr("_record", split + 4).cast("binary").alias("_body"),
    )

    def field(name: str) -> Column:
        at = F.regexp_extract("_head", rf"(?s)\r\n{name}: ([^\r]*)\r", 1)
        return F.when(at != "", at)

    def page(text: Column) -> Column:
        return F.regexp_extract(text, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    rows = rows.select(
        page(field("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"),
        F.try_to_timestamp(field("WARC-Date"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("time"),
        field("WARC-Type").alias("record_type"), page(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Payload-Length").cast("long").alias("_bytes"),
        F.substr(field("WARC-Payload-Digest"), F.lit(6)).alias("_digest"),
        field("Content-Length").cast("int").alias("_length"), "_body",
    )
    ends = F.octet_length("_body") - F.col("_length")
    tail = F.substring(F.col("_body"), F.col("_length") + 1, ends)
    whole = (ends == 0) | ((ends == 4) & (tail == F.lit((EOL * 2).encode())))
    bad = F.raise_error(F.concat(F.lit("record of another length than it states: page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_body", F.when(whole, F.substring(F.col("_body"), F.lit(1), F.col("_length"))).otherwise(bad))
    # The payload follows the HTTP header, whose characters are plain.
    header = F.instr(F.decode(F.substring(F.col("_body"), F.lit(1), F.lit(512)), "ISO-8859-1"), EOL * 2) + 3
    response = F.col("record_type") == "response"
    rows = rows.withColumn("payload", F.when(response, F.substring(F.col("_body"), header + 1, F.col("_length") - header)))
    return rows.select(
        "page_id", "url", "time",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(response, payload_digest(F.col("payload"))).otherwise(F.col("_digest")).alias("payload_digest"),
        "record_type", "refers_to", F.col("payload").cast("string").alias("payload"),
    )


class LoserTree:
    """Merges sorted lists: a tournament whose inner nodes keep the losers, so the next winner takes one match a level."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.losers = [-1] * size
        # -1 stands for a run that is over, and loses against all.
        winner = [-1] * size + [i if i < len(runs) and runs[i] else -1 for i in range(size)]
        for node in range(size - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winner[1]

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes first; equal heads go in the order of the runs."""
        if a < 0 or b < 0:
            return b < 0
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) in order."""
        losers, runs, at = self.losers, self.runs, self.at
        while self.winner >= 0:
            run = self.winner
            yield run, at[run]
            at[run] += 1
            up = run if at[run] < len(runs[run]) else -1
            node = (run + self.size) // 2
            while node:
                other = losers[node]
                if self._before(other, up):
                    losers[node], up = up, other
                node //= 2
            self.winner = up


ENTRY = "url_key string, time timestamp, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ORDER = ["url_key", "time", "page_id", "payload_digest", "record_type"]


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [(c, "ascending") for c in _ORDER], null_placement="at_start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, run, held = TaskContext.get().partitionId(), 0, []

    def close() -> Iterator[pa.RecordBatch]:
        for batch in _sorted(pa.Table.from_batches(held)).to_batches():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{run}"] * batch.num_rows), *batch.columns], ["run", *batch.schema.names]
            )

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            yield from close()
            held, run = [], run + 1
    if held:
        yield from close()


def _keys(table: pa.Table) -> list[tuple]:
    """Comparable keys, nulls first. Strings compare by code point here and by byte in the runs, which is the same."""
    columns = []
    for name in _ORDER:
        column = table.column(name)
        if pa.types.is_timestamp(column.type):
            column = column.cast(pa.int64())
        columns.append([(v is not None, v) for v in column.to_pylist()] if column.null_count else column.to_pylist())
    return list(zip(*columns, strict=True))


def merged(table: pa.Table) -> pa.Table:
    """The rows of a range in order. Rows that ascend where they stand are a run; runs are merged by a loser tree."""
    keys = _keys(table)
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1])] if keys else []
    ends = [*starts[1:], len(keys)]
    tree = LoserTree([keys[a:b] for a, b in zip(starts, ends, strict=True)])
    return table.take(pa.array([starts[run] + at for run, at in tree], pa.int64()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        yield from merged(pa.Table.from_batches(held)).to_batches()


def capture_index(records: DataFrame) -> DataFrame:
    """Captures of ``records`` (the columns of ``read_archives`` but the payload) in global order of URL key, time, page_id.

    The order is that of the partitions, and of the rows within each; a table written from it keeps it in its files.
    Null times and ids come first, records without a URL before all others; equal entries are all kept. What a task
    holds is a range of about RANGE_ROWS entries. The run and the place in it are part of the range key, so a URL with
    any number of captures, even equal ones, is dealt to as many ranges as it needs.
    """
    entries = records.select(url_key(F.col("url")).alias("url_key"), "time", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    runs = written(entries.mapInArrow(_runs, "run string, " + ENTRY), "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, *_ORDER, "run", "_at")
    return dealt.drop("run", "_at").mapInArrow(_merge, ENTRY)


def capture_histories(index: DataFrame) -> DataFrame:
    """Per URL key: captures, responses, distinct payloads, first and last time. Combines before the exchange."""
    return index.groupBy("url_key").agg(
        F.count("*").alias("captures"), F.count_if(F.col("record_type") == "response").alias("responses"),
        F.count_distinct("payload_digest").alias("payloads"), F.min("time").alias("first"), F.max("time").alias("last"),
    )

"""Extension points: new feeds, reputation providers and alert sources are registered here by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave import schemas
from iocweave.sources import feeds


@dataclass(frozen=True)
class Feed:
    """A landed feed: how its files are read and how they become indicator rows. ``judge``, if there is one, gives all
    rows with the ``reason`` why one is refused."""

    name: str
    group: str
    schema: str
    flatten: Callable[[DataFrame, Column], DataFrame]
    fmt: str = "json"
    judge: Callable[[DataFrame, Column], DataFrame] | None = None


FEEDS: dict[str, Feed] = {}


def register_feed(feed: Feed) -> None:
    FEEDS[feed.name] = feed
    feeds.FEED_RANK.setdefault(feed.group, len(feeds.FEED_RANK))


for _name, _group, _schema_of, _flatten, _fmt in (
    ("otx", "otx", schemas.OTX, feeds.flatten_otx, "json"),
    ("abusech_malware", "abusech", schemas.MALWARE, feeds.flatten_malware, "json"),
    ("abusech_url", "abusech", schemas.URLS, feeds.flatten_urls, "json"),
    ("threatfox", "abusech", schemas.THREATFOX, feeds.flatten_threatfox, "json"),
    ("csv", "csv", schemas.CSV, feeds.flatten_csv, "csv"),
):
    register_feed(Feed(_name, _group, _schema_of, _flatten, _fmt, partial(_flatten, judged=True)))


def _options(feed: Feed, multi_line: bool = False) -> dict[str, str]:
    if feed.fmt == "csv":
        # A field with line breaks keeps a file from being split: one task then reads it whole.
        return {"header": "true", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _schema(feed: Feed) -> str:
    return feed.schema if feed.fmt == "csv" else feed.schema + ", _corrupt_record string"


def _place() -> list[Column]:
    """File and block of a landed line. Landed files are named so that they sort in fetch order; the whole path keeps
    files of one name in two folders apart."""
    block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    return [F.col("_metadata.file_name"), F.col("_metadata.file_path"), block]


def _with_fetch_id(df: DataFrame) -> DataFrame:
    """An id for each landed line that sorts by file and then by place in the file.

    Rows of a block are numbered by their place in the task that reads it, which grows along the block.
    """
    row = F.lpad((F.monotonically_increasing_id() % (1 << 33)).cast("string"), 10, "0")
    return df.withColumn("fetch_id", F.concat_ws("#", *_place(), row))


def _with_stream_id(df: DataFrame) -> DataFrame:
    """The same for streams, where rows cannot be numbered: a digest of the line tells lines of a block apart."""
    # A digest over JSON text, because VARIANT columns have no hash.
    digest = F.hex(F.xxhash64(F.to_json(F.struct(*df.columns))))
    return df.withColumn("fetch_id", F.concat_ws("#", *_place(), digest))


def read_feed(
    spark: SparkSession, name: str, path: str, now: Column, multi_line: bool = False, judged: bool = False
) -> DataFrame | None:
    """Batch read of one landed feed; None if nothing has landed. ``multi_line``: CSV fields may hold line breaks.
    ``judged``: all rows, with the ``reason`` of those that are refused, for ``feeds.split_judged``."""
    feed = FEEDS[name]
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.globStatus(hadoop_path):
        return None
    landed = spark.read.format(feed.fmt).options(**_options(feed, multi_line)).schema(_schema(feed)).load(path)
    if not judged:
        return feed.flatten(_with_fetch_id(landed), now)
    if feed.judge is None:
        raise ValueError(f"feed {name} does not give reasons")
    return feeds.judge_values(feed.judge(_with_fetch_id(landed), now))


def read_feeds(spark: SparkSession, paths: dict[str, str], now: Column) -> DataFrame:
    """All landed feeds in one DataFrame; one that is missing does not lose the others."""
    return feeds.union_feeds([read_feed(spark, name, path, now) for name, path in paths.items()], spark)


def stream_feed(spark: SparkSession, name: str, path: str, now: Column, files_per_batch: int = 1000) -> DataFrame:
    """The same flattener on a file stream."""
    feed = FEEDS[name]
    landed = (
        spark.readStream.format(feed.fmt)
        .options(**_options(feed))
        .option("maxFilesPerTrigger", files_per_batch)
        .schema(_schema(feed))
        .load(path)
    )
    return feed.flatten(_with_stream_id(landed), now)


@dataclass(frozen=True)
class Provider:
    """A reputation provider: the types it answers for and how landed answers become result rows."""

    name: str
    supported_types: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]


PROVIDERS: dict[str, Provider] = {}


def register_provider(provider: Provider) -> None:
    PROVIDERS[provider.name] = provider


@dataclass(frozen=True)
class AlertSource:
    """An alert source: column expressions over the parsed alert (a VARIANT) and, for the candidates, its text.

    ``parts`` are what the candidates are made of: functions of the alert and of the parts before. They become columns,
    computed once, and are given to ``candidates`` after the text.
    """

    name: str
    alert_id: Callable[[Column], Column]
    alert_name: Callable[[Column], Column]
    severity: Callable[[Column], Column]
    triggered_at: Callable[[Column], Column]
    candidates: Callable[..., Column]
    parts: tuple[Callable[..., Column], ...] = ()


ALERT_SOURCES: dict[str, AlertSource] = {}


def register_alert_source(source: AlertSource) -> None:
    ALERT_SOURCES[source.name] = source

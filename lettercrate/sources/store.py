"""The stored archive: emails, errors, imported files, counts by level and settings as Parquet tables in one folder.

Each table holds a folder for each import (batch=...), emails in it one for each year, the first drill-down level, so that
choosing a year prunes the rest. A whole import is one batch and replaces all others; an incremental one adds its own. Which
batches are live is said by snapshots, so a write shows in all tables at once or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettercrate.operators.query import LEVELS, level_cells, merged_cells
from lettercrate.plans.fields import EMAILS, ERRORS, FILES
from lettercrate.sources import snapshots
from lettercrate.sources.archives import FORMATS, PARSERS, read_archive
from lettercrate.sources.parse import failed, good, parse_archive, positioned


@dataclass(frozen=True)
class Config:
    """Settings of an import."""

    database_path: str
    emails_folder_path: str
    format: str = "mbox"
    sender_emails: tuple[str, ...] = field(default=())
    persistent: bool = True

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format}")

    def rows(self) -> list[tuple[str, str]]:
        values = asdict(self) | {"sender_emails": ", ".join(sorted(self.sender_emails))}
        return [(k, json.dumps(v)) for k, v in sorted(values.items())]

    @classmethod
    def of_rows(cls, rows: list[tuple[str, str]]) -> Config:
        values = {k: json.loads(v) for k, v in rows}
        for name in ("database_path", "emails_folder_path", "format", "sender_emails", "persistent"):
            if name not in values:
                raise KeyError(f"missing field {name}")
        senders = tuple(x.strip() for x in values["sender_emails"].split(",") if x.strip())
        return cls(values["database_path"], values["emails_folder_path"], values["format"], senders, bool(values["persistent"]))


def save_config(spark: SparkSession, config: Config) -> None:
    spark.createDataFrame(config.rows(), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{config.database_path}/meta")


def load_config(spark: SparkSession, path: str) -> Config:
    return Config.of_rows([tuple(r) for r in spark.read.schema("key string, value string").parquet(f"{path}/meta").collect()])


#: The tables that snapshots cover.
TABLES = ("emails", "errors", "files", "cells")


def write_emails(emails: DataFrame, place: str) -> None:
    """Rows of a year are brought together, a large year in several files, so a write leaves few files whatever the number
    of tasks."""
    emails.select([f.name for f in EMAILS.fields]).hint("rebalance", "year").write.partitionBy("year").parquet(place)


def _open(spark: SparkSession, path: str, table: str, schema: T.StructType | str, batches: tuple[snapshots.Batch, ...] | None = None) -> DataFrame:
    """A table of the archive, of its live batches unless told otherwise; an archive that doesn't exist yet is an empty one."""
    live = snapshots.current(spark, path).batches if batches is None else batches
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/{b.folder}" for b in live])


def open_emails(spark: SparkSession, path: str) -> DataFrame:
    return _open(spark, path, "emails", EMAILS).select([f.name for f in EMAILS.fields])


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def open_errors(spark: SparkSession, path: str) -> DataFrame:
    return _open(spark, path, "errors", ERRORS).select(_names(ERRORS))


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that are imported, a row each: key, path, length (as far as it was read), modified."""
    rows = _open(spark, path, "files", FILES)
    last = F.max(F.struct(F.coalesce("length", F.lit(-1)).alias("length"), "modified", "path"))
    return rows.groupBy("key").agg(last.alias("x")).select("key", "x.path", F.nullif("x.length", F.lit(-1)).alias("length"), "x.modified")


CELLS = ", ".join(f"{n} {next(f.dataType.simpleString() for f in EMAILS.fields if f.name == n)}" for n in LEVELS) + ", amount bigint"


def open_cells(spark: SparkSession, path: str) -> DataFrame:
    """Mails per group of all drill-down levels together. Each import has left its own counts, which are added up here; no
    mail is read. Q.drill_cube(cells, weight="amount") and Q.segments(cells, name, weight="amount") answer from them."""
    return merged_cells(_open(spark, path, "cells", CELLS).select(_names(CELLS)))


def file_key(path: str | Column, format: str | Column) -> Column:
    """What tells imported files apart: the path; a Maildir message may move from new to cur and get other flags."""
    path, format = (F.col(x) if isinstance(x, str) else x for x in (path, format))
    return F.when(format == "maildir", F.regexp_replace(path, r"/(?:new|cur)/([^/:]*)(?::2,[A-Za-z]*)?$", "/$1")).otherwise(path)


def write_parsed(
    parsed: DataFrame, path: str, batch: str | None = None, progress: Callable[[str, int], None] | None = None, sizes: DataFrame | None = None,
    since: DataFrame | None = None, files: DataFrame | None = None, expected: int | None = None,
) -> dict[str, int]:
    """Writes the rows and the errors of parsed messages; returns the counts read, written and failed.

    batch: adds a batch of this key, in place of one that has the same; without it what is written replaces all batches.
    Messages are parsed once, into a table beside the others that is deleted at the end, so an executor that is lost in
    between takes nothing along, and counted while they are written. Nothing shows before the snapshot that ends the
    write. progress is told of the steps: ("read", messages), ("failed", errors), ("write", mails to write), ("written",
    mails), ("done", messages).

    sizes: see positioned(). since: path, start; of these files only messages from that position on are kept, which are
    the ones read. files: path, length, modified of files that count as imported besides those of the messages. expected:
    the version of the snapshot that this write builds on; any other is a snapshots.Conflict.
    """
    tell = progress or (lambda step, n: None)
    spark, name = parsed.sparkSession, uuid.uuid4().hex
    staging, new = f"{path}/_staging/{name}", snapshots.Batch(f"batch={name}", batch or "all")
    try:
        seen, fails, items = Observation(), F.col("error").isNotNull(), F.coalesce(~F.col("place.text"), F.lit(True))
        parsed.observe(seen, F.count_if(items).alias("read"), F.count_if(items & fails).alias("failed")).write.parquet(staging)
        every = spark.read.schema(parsed.schema).parquet(staging)
        kept = positioned(every, sizes)
        if since is not None:
            kept = kept.join(F.broadcast(since.select("path", "start")), "path", "left").where("start is null or coalesce(position >= start, true)").drop("start")
            found = kept.agg(F.count_if(items).alias("read"), F.count_if(items & fails).alias("failed")).first().asDict()
        else:
            found = seen.get
        counts = {"read": found["read"], "written": found["read"] - found["failed"], "failed": found["failed"]}
        tell("read", counts["read"])
        tell("failed", counts["failed"])
        tell("write", counts["written"])
        mails = good(kept)
        write_emails(mails, f"{path}/emails/{new.folder}")
        tell("written", counts["written"])
        failed(every if since is None else kept).write.parquet(f"{path}/errors/{new.folder}")  # places are only needed to choose by them
        known = every.select(file_key("path", "format").alias("key"), "path", F.col("place.file_length").alias("length"), F.col("place.file_time").alias("modified"))
        if files is not None:
            known = known.unionByName(files.select(F.col("path").alias("key"), "path", "length", "modified"))
        known = known.where("path is not null").groupBy("key", "path").agg(F.max("length").alias("length"), F.max("modified").alias("modified"))
        known.write.parquet(f"{path}/files/{new.folder}")
        stored = spark.read.schema(EMAILS).parquet(f"{path}/emails/{new.folder}")
        level_cells(stored).write.parquet(f"{path}/cells/{new.folder}")

        def live(base: snapshots.Snapshot) -> tuple[tuple[snapshots.Batch, ...], str | None]:
            others = () if batch is None else tuple(b for b in base.batches if b.key != batch)
            return (*others, replace(new, counts=counts)), name if batch is None else None

        snapshots.changed(spark, path, live, expected)
    except BaseException:
        for table in TABLES:
            snapshots.delete(spark, f"{path}/{table}/{new.folder}")
        raise
    finally:
        snapshots.delete(spark, staging)
    snapshots.expire(spark, path, TABLES)
    tell("done", counts["read"])
    return counts


def import_archive(spark: SparkSession, config: Config, compat_reply: bool = False, progress: Callable[[str, int], None] | None = None) -> dict[str, int]:
    """Reads, parses and stores an archive, and its settings. A message that can't be read goes to the errors.

    Replaces what was stored, incremental batches included, at the moment when all of it is written; settings are saved
    then too, so an archive that isn't there leaves those of the last import. Items are parsed as their format says
    (register_format).
    """
    raw = read_archive(spark, config.emails_folder_path, config.format)
    parsed = parse_archive(raw, list(config.sender_emails), compat_reply, parser=PARSERS.get(config.format), parts=True)
    counts = write_parsed(parsed, config.database_path, progress=progress)
    save_config(spark, config)
    return counts

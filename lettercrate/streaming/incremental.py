"""Incremental import: only what no earlier import, whole or incremental, has stored.

The table of imported files belongs to the archive's snapshots, so it always says what the live mails came from: a whole
import takes the files of the batches that it replaces out of it. Arrivals are compared with it in every run.

Formats with a file for each message: a stream lists files as they arrive, without reading them; those that the table
doesn't know are opened and imported. The stream's checkpoint spares a run the files of earlier ones; it belongs to the time
between two whole imports, after which all files are compared anew.

mbox: a file is known up to the length that was read, so mails that were added to it since are found by their position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.sources import archives, snapshots
from lettercrate.sources.parse import parse_archive
from lettercrate.sources.store import file_key, open_emails, open_files, write_parsed

Progress = Callable[[str, int], None]
#: How often a batch is compared and imported anew after another writer was faster.
TRIES = 5


def _plain_rows(mails: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return archives.raw_rows(mails, F.col("path"), F.col("content"), none, F.lit(None).cast("boolean"), "eml")


def _kind(spark: SparkSession, folder: str, name: str, glob: str) -> tuple[str, str, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """(where a format's files are, what their names match, options to read them, what makes RAW rows of them)"""
    if name == "eml":
        return folder, glob, {}, _plain_rows
    if name == "apple":
        return folder, "*.emlx", {}, archives.apple_rows
    if name == "maildir":
        return archives.maildir_glob(spark, folder), "*", archives.COLONS, lambda mails: archives.maildir_rows(mails, folder)
    if name == "gmailvault":
        return folder, "*.{eml,eml.gz}", {}, lambda mails: archives.gmail_rows(mails, archives.gmail_notes(spark, folder))
    raise ValueError(f"no incremental import of {name}")


def _again(f: Callable[[], None]) -> None:
    for left in reversed(range(TRIES)):
        try:
            return f()
        except snapshots.Conflict:
            if not left:
                raise


def _import_files(spark: SparkSession, folder: str, database_path: str, senders, glob: str, files_per_batch: int, name: str, progress: Progress | None) -> None:
    place, pattern, options, raw_of = _kind(spark, folder, name, glob)
    era = snapshots.current(spark, database_path).era
    arrivals = archives.files(spark, place, pattern, streaming=True, maxFilesPerTrigger=str(files_per_batch), **options).select("path")

    def store(batch: DataFrame, number: int) -> None:
        found = batch.select("path", file_key("path", F.lit(name)).alias("key"))
        key = f"new-{name}-{era}-{number}"

        def attempt() -> None:
            base = snapshots.current(spark, database_path)
            if any(b.key == key for b in base.batches):
                return  # stored, but the stream didn't come to note it
            new = found.join(open_files(spark, database_path).select("key"), "key", "left_anti")
            paths = [archives.escaped(r["path"]) for r in new.groupBy("key").agg(F.max("path").alias("path")).collect()]  # no more than files_per_batch
            if paths:
                mails = archives.in_few_tasks(spark.read.format("binaryFile").options(**options).load(paths))
                write_parsed(parse_archive(raw_of(mails), senders, parts=True), database_path, batch=key, progress=progress, expected=base.version)

        _again(attempt)

    checkpoint = f"{database_path}/_checkpoint/{name}-{era or 'first'}"
    query = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _import_mbox(spark: SparkSession, folder: str, database_path: str, senders, files_per_batch: int, progress: Progress | None) -> None:
    listed = archives.files(spark, folder, "*").where(F.contains("path", F.lit(".mbox"))).select("path", "length", F.col("modificationTime").alias("modified"))

    def attempt() -> bool:
        base = snapshots.current(spark, database_path)
        known = open_files(spark, database_path).select("path", F.col("length").alias("start"))
        grown = listed.where("length > 0").join(known, "path", "left").where("start is null or length > start").orderBy("path").limit(files_per_batch)
        rows = grown.select("path", "length", "modified", "start").collect()  # no more than files_per_batch
        if not rows:
            return False
        since = spark.createDataFrame([(r["path"], r["start"]) for r in rows if r["start"] is not None], "path string, start bigint")
        read = spark.createDataFrame([(r["path"], r["length"], r["modified"]) for r in rows], "path string, length bigint, modified timestamp")
        parts = archives.mbox_parts(spark, [archives.escaped(r["path"]) for r in rows])
        sizes = parts.select("path", "block", "bytes")
        # a share of a file that ends before what is new isn't parsed; where the rest begins is known from the sizes
        unread = parts.join(F.broadcast(since), "path", "left").where("start is null or block_end >= start").drop("start")
        parsed = parse_archive(archives.mbox_rows(unread), senders, parts=True)
        some = {"sizes": sizes, "since": since} if any(r["start"] is not None for r in rows) else {}  # files that are all new are parsed whole, in one scan
        write_parsed(parsed, database_path, batch=f"new-mbox-{base.version + 1}", progress=progress, files=read, expected=base.version, **some)
        return True

    while True:
        more = []
        _again(lambda: more.append(attempt()))
        if not more[-1]:
            return


def import_new(
    spark: SparkSession, folder: str, database_path: str, sender_emails: tuple[str, ...] | DataFrame = (), glob: str = "*.eml", files_per_batch: int = 10_000,
    name: str = "eml", progress: Progress | None = None,
) -> None:
    """Imports what arrived in folder since the last import, with the tags and flags of its format, then ends.

    name: "eml" for single messages (files that match glob), or an archive format; a Gmail message is imported with the
    sidecar that is there when its batch runs. A file with one message is imported once, even if it changes later. Mails
    that were added to the end of an mbox file are imported; what changes in front of that isn't seen, nor is a file that got
    shorter, until a whole import reads it anew.

    Batches add to a whole import (import_archive) of the same database, which may be before or after: every mail is stored
    once, whatever the order. A run that broke off goes on where it was.
    """
    senders = sender_emails if isinstance(sender_emails, DataFrame) else list(sender_emails)
    if name == "mbox":
        _import_mbox(spark, folder, database_path, senders, files_per_batch, progress)
    else:
        _import_files(spark, folder, database_path, senders, glob, files_per_batch, name, progress)


def open_imported(spark: SparkSession, database_path: str) -> DataFrame:
    """The emails of all imports into a database."""
    return open_emails(spark, database_path)

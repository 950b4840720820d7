"""URL filters: dated list entries become validity intervals, captures are judged by the entries active when fetched.

An entry adds a key to a list or removes it from a date on. A key is a host, which also covers its subdomains, or a
host and a path prefix ("example.com/ads/"). An interval lasts from an addition to the next entry for that list and
key. Intervals are cut at month ends, so the as-of join is an equality on (key, month) with the exact times as a
further condition; a host with a third of all captures, or a key switched on and off many times, is spread over
months, and what remains uneven is left to Spark's skew-join splitting. Everything is DataFrame expressions.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettercrate.llm.common import written


def intervals(entries: DataFrame, until: datetime) -> DataFrame:
    """list, key, action, valid_from, valid_to (exclusive) of the additions in entries.

    entries: list, key, at (timestamp), adds (boolean). Of several entries for a list and key at one time an
    addition wins; rows with a null list, key, time or adds are left out; an open interval ends at ``until``.
    Entries dated after ``until`` play no part.
    """
    entries = entries.where("list is not null and key is not null and at is not null and adds is not null")
    once = entries.groupBy("list", "key", "at").agg(F.max("adds").alias("adds"))
    w = Window.partitionBy("list", "key").orderBy("at")
    ends = once.withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.lit(until)))
    return ends.where("adds and at < valid_to").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """The path of a URL, from its first slash up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels_most: int, folders_most: int) -> Column:
    """All keys that can cover a URL: the host and its parent domains, each alone and with the path prefixes that end
    in a slash. Keys longer than any entry (in labels, in folders) are left out: nothing can match them."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - (labels_most - 1))
    parents = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/", folders_most + 2)
    counts = F.filter(F.sequence(F.lit(0), F.lit(folders_most)), lambda i: i <= F.size(steps) - 2)
    prefixes = F.transform(counts, lambda i: F.concat(F.array_join(F.slice(steps, 1, i + 1), "/"), F.lit("/")))
    both = F.flatten(F.transform(parents, lambda p: F.concat(F.array(p), F.transform(prefixes, lambda f: F.concat(p, f)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def evaluate(captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
    """A row for each row of captures: its columns, host, n_active (entries of other lists than ``allow`` active at
    fetch time), blocked_by (the smallest name of such a list, or null), allowed (an entry of the list ``allow`` is
    active) and blocked (n_active > 0 and not allowed).

    captures: url, fetched (timestamp) and any further columns; columns named like the new ones are replaced. A null
    url or time matches nothing. An entry added at the very moment of the fetch is active, one removed at it is not.
    """
    asked = captures.select("url", "fetched").where("url is not null and fetched is not null")
    last = asked.agg(F.max("fetched")).first()[0]
    until = last + timedelta(seconds=1) if last else datetime(1970, 1, 1)
    # an interval still open reaches no further than the last capture
    spans = written(intervals(entries, until))
    parts = F.split("key", "/", 2)
    longest = spans.agg(F.max(F.size(F.split(F.get(parts, F.lit(0)), r"\."))), F.max(F.size(F.split("key", "/")) - 2)).first()
    months = F.sequence(F.date_trunc("month", "valid_from"), F.date_trunc("month", F.expr("valid_to - interval 1 microsecond")), F.expr("interval 1 month"))
    spans = spans.withColumn("month", F.explode(months))

    asked = asked.distinct().withColumns({"host": host_of(F.col("url")), "month": F.date_trunc("month", "fetched")})
    keys = keys_of(F.col("host"), path_of(F.col("url")), max(1, longest[0] or 1), max(0, longest[1] or 0))
    asked = asked.select("url", "fetched", "month", F.explode(keys).alias("key"))
    active = asked.join(spans, ["key", "month"]).where("valid_from <= fetched and fetched < valid_to")
    other = F.col("list") != allow
    found = active.groupBy("url", "fetched").agg(
        F.count_if(other).alias("n_active"), F.min(F.when(other, F.col("list"))).alias("blocked_by"), F.bool_or(~other).alias("allowed")
    )
    new = ["host", "n_active", "blocked_by", "allowed", "blocked"]
    out = captures.drop(*new).join(found, ["url", "fetched"], "left")
    out = out.withColumns({"host": host_of(F.col("url")), "n_active": F.coalesce("n_active", F.lit(0)).cast("long"), "allowed": F.coalesce("allowed", F.lit(False))})
    return out.withColumn("blocked", (F.col("n_active") > 0) & ~F.col("allowed"))

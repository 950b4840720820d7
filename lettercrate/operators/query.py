"""The query shapes: grouped counts, pages, distinct values, and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettercrate.functions.filters import Predicate, where
from lettercrate.plans.fields import DEFAULT, GROUPABLE, FieldMap, title

LEVELS = ("year", "sender_domain", "sender_local_part", "month", "day")


def group_key(name: str, fields: FieldMap = DEFAULT) -> Column:
    """A group's value: for texts null and '' are one group."""
    column = fields.column(name)
    return (F.coalesce(column, F.lit("")) if fields.kind(name) == "text" else column).alias(name)


def _amount(weight: str | None) -> Column:
    return (F.sum(weight) if weight else F.count("*")).alias("amount")


def segments(df: DataFrame, name: str, predicates: Iterable[Predicate] = (), fields: FieldMap = DEFAULT, weight: str | None = None) -> DataFrame:
    """(field, amount): rows per value of a field. Partial counts are summed after one shuffle of group keys.

    weight: a column that says for how many rows each stands, as in counts kept by level_cells.
    """
    return where(df, predicates, fields).groupBy(group_key(name, fields)).agg(_amount(weight))


def distinct_values(df: DataFrame, name: str, fields: FieldMap = DEFAULT) -> DataFrame:
    return df.select(group_key(name, fields)).distinct()


def catalog_counts(df: DataFrame, fields: FieldMap = DEFAULT) -> DataFrame:
    """(field, title, n_groups) of every field that can be a drill-down level: how many groups it would have. One job."""
    counts = df.agg(*[F.count_distinct(F.coalesce(group_key(n, fields).cast("string"), F.lit("\0"))).alias(n) for n in GROUPABLE])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(title(n)).alias("title"), F.col(n).alias("n_groups")) for n in GROUPABLE])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def known_tags(df: DataFrame, fields: FieldMap = DEFAULT) -> DataFrame:
    """Every tag that some mail has; '' is none."""
    return df.select(F.explode(fields.column("tags")).alias("tag")).where("tag != ''").distinct()


def count_per_tag(df: DataFrame, fields: FieldMap = DEFAULT) -> DataFrame:
    """Mails per tag; a tag that a mail has twice counts once."""
    tags = df.select(F.explode(F.array_distinct(fields.column("tags"))).alias("tag")).where("tag != ''")
    return tags.groupBy("tag").agg(F.count("*").alias("amount"))


def total(df: DataFrame, predicates: Iterable[Predicate] = (), fields: FieldMap = DEFAULT) -> DataFrame:
    return where(df, predicates, fields).agg(F.count("*").alias("total"))


def segment_total(grouped: DataFrame) -> DataFrame:
    return grouped.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))


def has_tags_has_seen(df: DataFrame, fields: FieldMap = DEFAULT) -> DataFrame:
    """One row: whether any mail has a tag, and whether any says if it was seen."""
    tags = F.size(F.array_remove(fields.column("tags"), "")) > 0
    return df.agg(
        F.coalesce(F.bool_or(tags), F.lit(False)).alias("has_tags"),
        F.coalesce(F.bool_or(fields.column("is_seen").isNotNull()), F.lit(False)).alias("has_seen"),
    )


def page(
    df: DataFrame,
    names: Sequence[str],
    start: int,
    end: int,
    predicates: Iterable[Predicate] = (),
    fields: FieldMap = DEFAULT,
    order: Sequence[str] = ("datetime", "path"),
    overscan: int = 0,
) -> DataFrame:
    """Rows start to end (exclusive), and ``overscan`` more, in a repeatable order.

    The sort is a top-k: each task keeps end + overscan rows of the named and ordering fields.
    """
    if not 0 <= start <= end:
        raise ValueError(f"no page from {start} to {end}")
    rows = where(df, predicates, fields)
    rows = rows.orderBy(*[fields.column(n) for n in order], *[fields.column(n) for n in names if n not in order])
    return rows.offset(start).limit(end - start + overscan).select(*[fields.column(n).alias(n) for n in names])


def page_order(df: DataFrame) -> tuple[str, ...]:
    """Fields that tell mails apart: several mails of one mbox file may share a second, but not a position."""
    return ("datetime", "path", "position") if "position" in df.columns else ("datetime", "path")


def _order_key(name: str, fields: FieldMap) -> Column:
    """Mails that aren't in an mbox file have no position and stand at -1."""
    return F.coalesce(fields.column(name), F.lit(-1)) if name == "position" else fields.column(name)


def page_after(
    df: DataFrame, names: Sequence[str], after: tuple | None, size: int, predicates: Iterable[Predicate] = (), fields: FieldMap = DEFAULT, order: Sequence[str] | None = None
) -> DataFrame:
    """The ``size`` rows that follow the row whose ordering fields are ``after`` (None: the first rows), with these fields
    in front. order: page_order(df) unless given.

    A deep page costs no more than the first: rows before it are filtered out, which reaches the scan, and each task
    keeps ``size`` rows. The ordering fields must tell rows apart, and only a position may be null.
    """
    order = tuple(order or page_order(df))
    rows = where(df, predicates, fields)
    if after is not None:
        if len(after) != len(order):
            raise ValueError(f"a value for each of {', '.join(order)} is needed")
        keys = [(_order_key(n, fields), F.lit(-1 if n == "position" and v is None else v)) for n, v in zip(order, after, strict=True)]
        follows = F.lit(False)
        for key, value in reversed(keys):
            follows = (key > value) | ((key == value) & follows)
        rows = rows.where(keys[0][0] >= keys[0][1]).where(follows)
    rows = rows.orderBy(*[_order_key(n, fields) for n in order]).limit(size)
    return rows.select(*[fields.column(n).alias(n) for n in (*order, *[n for n in names if n not in order])])


#: Rows of a range of a ranked table.
RANGE_ROWS = 100_000
#: Ranges of a ranked table, unless they would have more than RANGE_ROWS rows then: each costs the driver a task, a folder and a
#: sample of its keys.
RANGES = 256


def write_ranked(df: DataFrame, path: str, order: Sequence[str] | None = None, fields: FieldMap = DEFAULT, range_rows: int = RANGE_ROWS) -> None:
    """Writes df in order, cut into ranges of about ``range_rows`` rows, so that ranked_page() can open any page of it. Where
    that makes more than RANGES, ranges are longer, up to RANGE_ROWS rows.

    ``rows`` has a folder for each range; a row knows its place in it. ``ranges`` has a row for each range with the number
    of rows before it. One shuffle, by range; no task sorts more than a range. Rows that agree in all ordering fields are
    in one range, in any order.
    """
    order = tuple(order or page_order(df))
    keys = [_order_key(n, fields) for n in order]
    total = df.count()
    n = min(-(-total // range_rows), max(RANGES, -(-total // RANGE_ROWS)))
    rows = df.repartitionByRange(max(1, n), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumns({"_place": place, "_range": F.spark_partition_id()})
    (rows.write.partitionBy("_range") if n else rows.write).parquet(f"{path}/rows")  # without rows, a file that has the columns
    sizes = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/ranges")


def ranked_page(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows start to end (exclusive) of a table by write_ranked, with ``place`` in front, the row's number from 0.

    Only the ranges that the page lies in are read: two for a page that is no longer than a range, wherever it is.
    """
    if not 0 <= start <= end:
        raise ValueError(f"no page from {start} to {end}")
    met = spark.read.parquet(f"{path}/ranges").where((F.col("before") < end) & (F.col("before") + F.col("n") > start)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.where(F.col("_range").isin([r["_range"] for r in met]))
    first = F.lit(None).cast("bigint")
    for r in met:
        first = F.when(F.col("_range") == r["_range"], F.lit(r["before"])).otherwise(first)
    rows = rows.withColumn("place", first + F.col("_place")).where((F.col("place") >= start) & (F.col("place") < end))
    return rows.select("place", *[c for c in rows.columns if c not in ("_place", "_range", "place")])


def mail_list(df: DataFrame, start: int, end: int, predicates: Iterable[Predicate] = (), fields: FieldMap = DEFAULT, overscan: int = 6) -> DataFrame:
    """What the mail list shows of the visible rows: sender, date, subject, path."""
    names = ("sender_domain", "sender_local_part", "subject", "path", "timestamp")
    rows = page(df, names, start, end, predicates, fields, ("timestamp", "path"), overscan)
    return rows.select("path", sender().alias("sender"), day_of("timestamp").alias("date"), "subject")


def sender() -> Column:
    return F.concat_ws("@", "sender_local_part", "sender_domain")


def day_of(timestamp: str) -> Column:
    """An epoch as a day, in the session's zone (UTC)."""
    return F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM-dd")


def label(name: str) -> Column:
    """'value: #count' of a segment, the count with thousands separators."""
    return F.format_string("%s: #%s", F.col(name).cast("string"), F.format_number("amount", 0))


def by_size(grouped: DataFrame, name: str) -> DataFrame:
    return grouped.orderBy(F.desc("amount"), F.asc(name))


def segment_limit(grouped: DataFrame, name: str, n: int | None, keep: str = "smallest") -> DataFrame:
    """The n smallest (or largest) segments, by amount and then value; None, or n not below their number, keeps all."""
    if n is None:
        return grouped
    if n < 0 or keep not in ("smallest", "largest"):
        raise ValueError(f"can't keep the {n} {keep} segments")
    first = F.asc("amount") if keep == "smallest" else F.desc("amount")
    # of equal amounts the list, largest first, has the greater values last
    return grouped.orderBy(first, F.desc(name) if keep == "smallest" else F.asc(name)).limit(n)


def level_cells(df: DataFrame, levels: Sequence[str] = LEVELS, fields: FieldMap = DEFAULT) -> DataFrame:
    """(levels, amount): mails per group of all levels together. Those of parts of a table add up to those of the whole,
    so they can be kept by import and merged when they are read."""
    return df.groupBy(*[group_key(n, fields) for n in levels]).agg(F.count("*").alias("amount"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """One row a group for cells (any levels, amount) of several parts."""
    return cells.groupBy([c for c in cells.columns if c != "amount"]).agg(F.sum("amount").alias("amount"))


def drill_cube(df: DataFrame, levels: Sequence[str] = LEVELS, fields: FieldMap = DEFAULT, free_order: bool = False, weight: str | None = None) -> DataFrame:
    """All drill-down levels in one job: a row for each group of each level (level 0: all mails), with its amount.

    free_order: groups for every subset of the levels rather than every prefix; ``grouping`` tells them apart. weight: as
    for segments; without any rows, the amount of level 0 is null then.
    """
    rows = df.select(*[group_key(n, fields) for n in levels], *([F.col(weight)] if weight else []))
    rolled = rows.cube(*levels) if free_order else rows.rollup(*levels)
    out = rolled.agg(_amount(weight), F.grouping_id().cast("int").alias("grouping"))
    if free_order:
        return out
    return out.select(*levels, "amount", (len(levels) - F.bit_count("grouping")).cast("int").alias("level"))


def segment_share(grouped: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """grouped with, within each parent group, a segment's share, rank (largest first) and cumulative share.

    Works on grouped rows: as many as there are segments, not mails.
    """
    whole = Window.partitionBy(*parents)
    ranked = whole.orderBy(F.desc("amount"), F.asc(name))
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grouped.withColumns({
        "share": F.col("amount") / F.sum("amount").over(whole),
        "rank": F.row_number().over(ranked),
        "cumulative_share": F.sum("amount").over(running) / F.sum("amount").over(whole),
    })


def membership(df: DataFrame, column: str, members: DataFrame, member: str, flag: str) -> DataFrame:
    """df with a flag: whether the column's value is among the members. Nulls aren't.

    A plain left join: Spark broadcasts the members when they are small enough by its own check, else shuffles.
    """
    distinct = members.select(F.col(member).alias("_member")).where("_member is not null").distinct().withColumn("_found", F.lit(True))
    return df.join(distinct, df[column] == F.col("_member"), "left").withColumn(flag, F.coalesce("_found", F.lit(False))).drop("_member", "_found")

"""Queries of the mail operators over the test tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.functions import filters as P
from lettercrate.operators import query as Q
from lettercrate.plans.drill import DrillDown
from lettercrate.plans.fields import EMAILS, TAG_SEPARATOR, FieldMap, join_tags, split_tags
from lettercrate.plans.mailview import FIELDS, mail_view, with_mail
from lettercrate.plans.rendering import delete_files, mbox_lines, message_text, opened, write_files, write_joined
from lettercrate.sources import archives, snapshots, store
from lettercrate.sources.parse import good, parse_archive
from lettercrate.sources.synthetic import synthetic_mails
from lettercrate.streaming.incremental import import_new, open_imported

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, mail: bool = True) -> Callable[[Query], Query]:
    """Registers a function by its name, with SQL over the mail view (m) or over plain tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_mail(sql) if mail else sql
        return f

    return add


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lettercrate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


RECEIVED = (P.equals("is_send", False),)


@query("SELECT year, count(*) AS amount FROM m WHERE is_send = false GROUP BY year")
def segments_by_year(spark, sf_dir):
    return Q.segments(mail_view(spark, sf_dir), "year", RECEIVED, FIELDS)


@query("SELECT sender_domain, count(*) AS amount FROM m GROUP BY sender_domain")
def segments_by_domain(spark, sf_dir):
    return Q.segments(mail_view(spark, sf_dir), "sender_domain", fields=FIELDS)


@query("SELECT sender_local_part, count(*) AS amount FROM m GROUP BY sender_local_part")
def segments_by_address(spark, sf_dir):
    return Q.segments(mail_view(spark, sf_dir), "sender_local_part", fields=FIELDS)


@query("SELECT coalesce(to_group, '') AS to_group, count(*) AS amount FROM m GROUP BY 1")
def segments_by_to_group(spark, sf_dir):
    return Q.segments(mail_view(spark, sf_dir), "to_group", fields=FIELDS)


@query("SELECT sender_domain, count(*) AS amount FROM m WHERE year = 1996 GROUP BY sender_domain")
def drill_year_domain(spark, sf_dir):
    return DrillDown(mail_view(spark, sf_dir), fields=FIELDS).push(1996).segments()


@query(
    "SELECT day, count(*) AS amount FROM m WHERE year = 1996 AND sender_domain = 'nation-3.example' "
    "AND sender_local_part >= '' AND month = 5 AND is_send = false GROUP BY day"
)
def drill_all_levels(spark, sf_dir):
    """Year, domain, then month in the address's place, then day."""
    place = DrillDown(mail_view(spark, sf_dir), fields=FIELDS, defaults=("year", "sender_domain", "month", "day", "sender_local_part"))
    return place.push(1996).push("nation-3.example").push(5).set_filters(*RECEIVED).segments()


@query("SELECT year, count(*) AS amount FROM m WHERE to_group IS NULL OR to_group = '' GROUP BY year")
def drill_null_group(spark, sf_dir):
    return DrillDown(mail_view(spark, sf_dir), levels=("to_group",), fields=FIELDS, defaults=("to_group", "year")).push("").segments()


@query("SELECT path FROM m WHERE sender_local_part ILIKE 'CUSTOMER_00000001%'")
def filter_like(spark, sf_dir):
    return P.where(mail_view(spark, sf_dir), [P.like("sender_local_part", "CUSTOMER_00000001%")], FIELDS).select("path")


@query("SELECT path FROM m WHERE to_group NOT ILIKE 'group-6'")
def filter_not_like(spark, sf_dir):
    return P.where(mail_view(spark, sf_dir), [P.not_like("to_group", "group-6")], FIELDS).select("path")


@query("SELECT path, subject FROM m WHERE contains(lower(subject), lower('rE: order 1'))")
def filter_contains(spark, sf_dir):
    return P.where(mail_view(spark, sf_dir), [P.contains("subject", "rE: order 1")], FIELDS).select("path", "subject")


@query("SELECT path FROM m WHERE month = 7 AND to_count = 3")
def filter_is(spark, sf_dir):
    return P.where(mail_view(spark, sf_dir), [P.equals("month", 7), P.equals("to_count", 3)], FIELDS).select("path")


@query("SELECT path, is_reply, to_count, sender_domain FROM m WHERE is_reply = true AND to_count = 2 AND sender_domain = 'nation-3.example' AND subject <> 'x'' OR ''1'' = ''1'")
def filter_literals(spark, sf_dir):
    """A literal of each kind; one that holds quotes stays a text."""
    other = lambda fields: ~P.equals("subject", "x' OR '1' = '1")(fields)
    chosen = [P.equals("is_reply", True), P.equals("to_count", 2), P.equals("sender_domain", "nation-3.example"), other]
    return FIELDS.select(P.where(mail_view(spark, sf_dir), chosen, FIELDS), "path", "is_reply", "to_count", "sender_domain")


@query(
    "SELECT path FROM m WHERE is_send = false AND meta_is_seen = true AND is_reply = true "
    "AND list_contains(string_split(meta_tags, ':|:'), 'BUILDING') AND contains(lower(subject), '2-high')"
)
def filter_preset(spark, sf_dir):
    form = P.FilterState(is_seen=True, is_reply=True, tag="BUILDING", subject="2-HIGH")
    return P.where(mail_view(spark, sf_dir), form.predicates(), FIELDS).select("path")


@query("SELECT path FROM m WHERE list_has_any(string_split(meta_tags, ':|:'), ['1-URGENT', 'MACHINERY'])")
def tag_filter(spark, sf_dir):
    return P.where(mail_view(spark, sf_dir), [P.has_tag("1-URGENT", "MACHINERY")], FIELDS).select("path")


@query("SELECT DISTINCT unnest(string_split(meta_tags, ':|:')) AS tag FROM m")
def known_tags(spark, sf_dir):
    return Q.known_tags(mail_view(spark, sf_dir), FIELDS)


@query("SELECT tag, count(*) AS amount FROM (SELECT unnest(string_split(meta_tags, ':|:')) AS tag FROM m) GROUP BY tag")
def count_per_tag(spark, sf_dir):
    return Q.count_per_tag(mail_view(spark, sf_dir), FIELDS)


@query("SELECT DISTINCT sender_domain FROM m")
def distinct_domains(spark, sf_dir):
    return Q.distinct_values(mail_view(spark, sf_dir), "sender_domain", FIELDS)


@query(
    "SELECT unnest(['sender_domain', 'sender_local_part', 'sender_name', 'year', 'month', 'day', 'to_group', 'to_name', 'to_address']) AS field, "
    "unnest(['Domain', 'Address', 'Name', 'Year', 'Month', 'Day', 'Group', 'To name', 'To address']) AS title, unnest([a, b, c, d, e, f, g, h, i]) AS n_groups "
    "FROM (SELECT count(DISTINCT sender_domain) AS a, count(DISTINCT sender_local_part) AS b, count(DISTINCT sender_name) AS c, count(DISTINCT year) AS d, count(DISTINCT month) AS e, "
    "count(DISTINCT day) AS f, count(DISTINCT coalesce(to_group, '')) AS g, count(DISTINCT coalesce(to_name, '')) AS h, count(DISTINCT coalesce(to_address, '')) AS i FROM m)"
)
def catalog_counts(spark, sf_dir):
    return Q.catalog_counts(mail_view(spark, sf_dir), FIELDS)


@query("SELECT count(*) AS total FROM m")
def total_mails(spark, sf_dir):
    return Q.total(mail_view(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM m WHERE year = 1997")
def segment_total(spark, sf_dir):
    return DrillDown(mail_view(spark, sf_dir), fields=FIELDS).push(1997).count()


@query("SELECT bool_or(meta_tags <> '') AS has_tags, bool_or(meta_is_seen IS NOT NULL) AS has_seen FROM m")
def has_tags_has_seen(spark, sf_dir):
    return Q.has_tags_has_seen(mail_view(spark, sf_dir), FIELDS)


@query("SELECT path, subject FROM m ORDER BY datetime, path, subject LIMIT 50")
def page_first(spark, sf_dir):
    return DrillDown(mail_view(spark, sf_dir), fields=FIELDS).items(0, 50)


@query("SELECT path, subject, to_count FROM m WHERE is_send = false AND is_reply = true ORDER BY datetime, path, subject, to_count LIMIT 100 OFFSET 1000")
def page_middle(spark, sf_dir):
    form = P.FilterState(is_reply=True).predicates()
    return Q.page(mail_view(spark, sf_dir), ("path", "subject", "to_count"), 1000, 1100, form, FIELDS)


@query("SELECT datetime, path, subject FROM m WHERE datetime > TIMESTAMP '1996-06-30 00:00:00' OR (datetime = TIMESTAMP '1996-06-30 00:00:00' AND path > 'orders/5') ORDER BY datetime, path LIMIT 200")
def page_after(spark, sf_dir):
    return Q.page_after(mail_view(spark, sf_dir), ("path", "subject"), (datetime(1996, 6, 30), "orders/5"), 200, fields=FIELDS)


@query("SELECT sender_local_part, count(*) AS amount FROM m WHERE year = 1995 GROUP BY sender_local_part")
def drill_back_and_regroup(spark, sf_dir):
    """Into a domain and back out, then the second level by address in place of domain."""
    place = DrillDown(mail_view(spark, sf_dir), fields=FIELDS).push(1995).push("nation-3.example").pop()
    assert place.aggregated_by() == [("year", 1995, 0), ("sender_domain", None, 1)] and place.can_aggregate_more()
    return place.set_aggregation(1, "sender_local_part").segments()


@query("SELECT to_group, count(*) AS amount FROM (SELECT coalesce(to_group, '') AS to_group FROM m WHERE year = 1997 AND sender_domain = 'nation-7.example') GROUP BY to_group")
def drill_free_field(spark, sf_dir):
    """The third level by the first field that no level has yet, after those of the sender and the date."""
    place = DrillDown(mail_view(spark, sf_dir), fields=FIELDS).push(1997).push("nation-7.example")
    free = [n for n in place.aggregation_fields(2) if n.startswith("to_")]
    return place.set_aggregation(2, free[0]).segments()


@query("SELECT path, subject FROM m WHERE year = 1996 AND sender_domain = 'nation-5.example' ORDER BY datetime, path, subject LIMIT 40 OFFSET 10")
def drill_items(spark, sf_dir):
    """A page of what is chosen, whatever the filters say."""
    place = DrillDown(mail_view(spark, sf_dir), fields=FIELDS).push(1996).push("nation-5.example").set_filters(*RECEIVED)
    return place.items(10, 50, include_filters=False)


@query(
    "SELECT path, concat(sender_local_part, '@', sender_domain) AS sender, strftime(datetime, '%Y-%m-%d') AS date, subject "
    "FROM m WHERE is_send = false ORDER BY datetime, path LIMIT 46 OFFSET 20"
)
def mail_list_display(spark, sf_dir):
    return Q.mail_list(mail_view(spark, sf_dir), 20, 60, RECEIVED, FIELDS)


@query("SELECT sender_domain, count(*) AS amount FROM m GROUP BY 1 ORDER BY amount, sender_domain DESC LIMIT 7")
def segment_limit_smallest(spark, sf_dir):
    return Q.segment_limit(segments_by_domain(spark, sf_dir), "sender_domain", 7)


@query("SELECT sender_domain, count(*) AS amount FROM m GROUP BY 1 ORDER BY amount DESC, sender_domain LIMIT 7")
def segment_limit_largest(spark, sf_dir):
    return Q.segment_limit(segments_by_domain(spark, sf_dir), "sender_domain", 7, "largest")


@query("SELECT concat(CAST(year AS VARCHAR), ': #', format('{:,}', count(*))) AS label, count(*) AS amount FROM m GROUP BY year")
def segment_label(spark, sf_dir):
    grouped = Q.segments(mail_view(spark, sf_dir), "year", fields=FIELDS)
    return Q.by_size(grouped, "year").select(Q.label("year").alias("label"), "amount")


@query(
    "SELECT year, sender_domain, sender_local_part, month, day, count(*) AS amount, CAST(CASE WHEN grouping(year) = 1 THEN 0 "
    "WHEN grouping(sender_domain) = 1 THEN 1 WHEN grouping(sender_local_part) = 1 THEN 2 WHEN grouping(month) = 1 THEN 3 "
    "WHEN grouping(day) = 1 THEN 4 ELSE 5 END AS INT) AS level FROM m GROUP BY ROLLUP (year, sender_domain, sender_local_part, month, day)"
)
def drill_cube(spark, sf_dir):
    return Q.drill_cube(mail_view(spark, sf_dir), fields=FIELDS)


@query(
    "SELECT year, sender_domain, month, count(*) AS amount, CAST(grouping(year, sender_domain, month) AS INT) AS \"grouping\" "
    "FROM m GROUP BY CUBE (year, sender_domain, month)"
)
def drill_cube_free_order(spark, sf_dir):
    return Q.drill_cube(mail_view(spark, sf_dir), ("year", "sender_domain", "month"), FIELDS, free_order=True)


@query(
    "SELECT year, sender_domain, amount, amount / sum(amount) OVER (PARTITION BY year) AS share, "
    "CAST(row_number() OVER w AS INT) AS rank, sum(amount) OVER w / sum(amount) OVER (PARTITION BY year) AS cumulative_share "
    "FROM (SELECT year, sender_domain, count(*) AS amount FROM m GROUP BY 1, 2) "
    "WINDOW w AS (PARTITION BY year ORDER BY amount DESC, sender_domain ROWS UNBOUNDED PRECEDING)"
)
def segment_share(spark, sf_dir):
    grouped = mail_view(spark, sf_dir).groupBy("year", "sender_domain").agg(F.count("*").alias("amount"))
    return Q.segment_share(grouped, ["year"], "sender_domain")


# --- imports: the view is rendered as mail text, read back and compared column by column with the view itself

CARRIED = (
    "sender_domain", "sender_local_part", "sender_name", "datetime", "year", "month", "day", "subject", "to_count", "to_group", "to_name", "to_address", "is_reply", "is_send"
)
CARRIED_SQL = ", ".join(CARRIED)


def rendered(spark: SparkSession, sf_dir: str, break_every: int = 0) -> DataFrame:
    mails = mail_view(spark, sf_dir)
    return mails.select("*", message_text(break_every).alias("message"))


def raw_of(mails: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return mails.select("path", F.col("message").cast("binary").alias("content"), none.alias("path_tags"), F.lit(None).cast("boolean").alias("seen_hint"), F.lit("eml").alias("format"))


def own_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the view's own senders."""
    customers, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    own = customers.where("c_custkey % 50 = 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    local, domain = F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lower(F.replace("n_name", F.lit("_"), F.lit("-")))
    return own.select(F.concat(local, F.lit("@"), domain, F.lit(".example")).alias("address"))


def written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows, worked out once and read from shared storage, whose files tell Spark how small a table is."""
    place = shared_dir(spark)
    rows.write.parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def parsed_view(spark: SparkSession, sf_dir: str, break_every: int = 0) -> DataFrame:
    """The rendered view, parsed. The view's joins leave few partitions, so the messages are spread over all cores."""
    return parse_archive(raw_of(rendered(spark, sf_dir, break_every)), written(spark, own_addresses(spark, sf_dir)), partitions=spark.sparkContext.defaultParallelism)


def file_name() -> Column:
    """A file name for a mail, in one of some folders."""
    order = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    return F.concat(order % 100, F.lit("/"), F.replace("path", F.lit("/"), F.lit("-")))


#: Files of a round; so many rounds run at a time. Files that are deleted within half a minute mostly never reach the disk,
#: where deleting one takes many times as long.
ROUND_MAILS, ROUNDS_AT_A_TIME = 30_000, 2


def stored(spark: SparkSession, sf_dir: str, files_of: Callable[[DataFrame], DataFrame], name: str, below: str = "", files_a_mail: int = 1) -> DataFrame:
    """Mails of the files (name, content) that files_of makes of rendered ones, after they were written to shared storage and
    read as an archive.

    Small files take a block each, and the driver lists them. So mails come in rounds of bounded size, each an archive of its
    own that is deleted when its mails are stored; all mails are written and read. While the driver lists a round's files,
    the tasks of another one have the cores.
    """
    mails, place, out = mail_view(spark, sf_dir), shared_dir(spark), shared_dir(spark)
    rounds = max(1, -(-mails.count() * files_a_mail // ROUND_MAILS))
    view = mails.withColumn("_round", F.pmod(F.xxhash64("path"), F.lit(rounds)).cast("int"))
    view.repartition(rounds, "_round").write.partitionBy("_round").parquet(f"{place}/view")
    schema, own = view.drop("_round").schema, written(spark, own_addresses(spark, sf_dir))
    system, make = snapshots.file_system(spark, place)

    def store_round(i: int) -> None:
        folder, part = f"{place}/{i}/My Mail + 50% #1 é", f"{place}/view/_round={i}"
        if not system.exists(make(part)):
            return  # no mail is in this round
        part = spark.read.schema(schema).parquet(part).repartition(spark.sparkContext.defaultParallelism)
        items = files_of(part.select("*", message_text().alias("message")))
        write_files(items, folder)
        good(parse_archive(archives.read_archive(spark, folder + below, name), own)).write.parquet(f"{out}/{i}")
        delete_files(items, folder)
        snapshots.delete(spark, f"{place}/{i}")  # by now folders only, so this is quick

    with ThreadPoolExecutor(ROUNDS_AT_A_TIME) as pool:
        list(pool.map(store_round, range(rounds)))
    snapshots.delete(spark, place)
    return spark.read.schema(EMAILS).option("recursiveFileLookup", "true").parquet(out) if system.exists(make(out)) else spark.createDataFrame([], EMAILS)


@query(f"SELECT path, {CARRIED_SQL}, CAST(epoch(datetime) AS BIGINT) AS timestamp, datetime AS datetime_utc FROM m")
def import_round_trip(spark, sf_dir):
    return good(parsed_view(spark, sf_dir)).select("path", *CARRIED, "timestamp", "datetime_utc")


@query(f"SELECT {CARRIED_SQL}, 'orders' AS tags FROM m")
def import_mbox(spark, sf_dir):
    """Written as mbox files by Spark and read back from them."""
    folder = f"{shared_dir(spark)}/My orders + 50% #1 é.mbox"
    mbox_lines(mail_view(spark, sf_dir)).write.text(folder)
    mails = good(parse_archive(archives.read_archive(spark, folder, "mbox"), written(spark, own_addresses(spark, sf_dir))))
    return mails.select(*CARRIED, F.regexp_replace(F.array_join("tags", ","), "^part-.*$", "orders").alias("tags"))


#: Mails of an mbox file: about 50 MB.
BOX_MAILS = 100_000


def boxes_of(mails: DataFrame, least: int) -> int:
    """The number of mbox files for mails: at least so many, and more for many mails, so that no file grows with them."""
    return max(least, -(-mails.count() // BOX_MAILS))


def write_mailboxes(mails: DataFrame, folder: str, n: int, seed: int = 0) -> None:
    """n mbox files that hold all mails, each in the order of dates. The text of a mail says which order it is from; several
    files, and several orders of a file in a second."""
    box = F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(n))
    entries = mbox_lines(mails, "path", "datetime").select(F.format_string("box %03d é.mbox", box).alias("name"), F.col("value").alias("content"), "datetime", "path")
    write_joined(entries, folder, ("datetime", "path"), n)


def texts_at(rows: DataFrame, folder: str, size: int) -> DataFrame:
    """rows (path, position, subject, sender_local_part) with the ``size`` bytes at their position, each read from its place in
    the file; no file is held in memory."""

    def per_batch(batches):
        import pyarrow as pa

        system, _ = opened(folder)
        last, file = None, None
        for batch in batches:
            texts = []
            for path, position in zip(batch["path"].to_pylist(), batch["position"].to_pylist(), strict=True):
                if path != last:
                    last, file = path, system.open_input_file(re.sub(r"^\w[\w+.-]*:(?://[^/]*)?(?=/)", "", path))
                texts.append(file.read_at(min(size, file.size() - position), position))
            yield pa.RecordBatch.from_arrays([batch["subject"], batch["sender_local_part"], pa.array(texts, pa.binary())], names=["subject", "sender_local_part", "text"])

    rows = rows.select("path", "position", "subject", "sender_local_part").repartition("path").sortWithinPartitions("path", "position")
    return rows.mapInArrow(per_batch, "subject string, sender_local_part string, text binary")


@query("SELECT path FROM m UNION ALL SELECT concat('in place: ', CAST(count(*) AS VARCHAR)) FROM m")
def import_positions(spark, sf_dir):
    """Mails of mbox files that were split between tasks; and how many have the separator line of their own order at their
    position, read from the files."""
    folder, path, mails = shared_dir(spark), shared_dir(spark), mail_view(spark, sf_dir)
    write_mailboxes(mails, folder, boxes_of(mails, 1 + spark.sparkContext.defaultParallelism))
    store.import_archive(spark, store.Config(path, folder, "mbox"))
    order = F.regexp_extract("text", r"\nMessage-Id: <orders\.(\d+)@", 1)
    rows = texts_at(store.open_emails(spark, path), folder, 2000).withColumn("text", F.col("text").cast("string"))
    rows = rows.withColumn("text", F.regexp_extract("text", r"(?s)\A(From .*?\n)(?=From |\z)", 1)).withColumn("order", order)
    placed = F.startswith("text", F.concat(F.lit("From "), "sender_local_part", F.lit(" "))) & F.contains("text", F.concat(F.lit("\nSubject: "), "subject", F.lit("\n")))
    named = rows.select(F.concat(F.lit("orders/"), "order").alias("path"), placed.alias("placed"))
    return named.select("path").unionByName(named.agg(F.concat(F.lit("in place: "), F.count_if("placed").cast("string")).alias("path")))


@query(f"SELECT {CARRIED_SQL}, 'INBOX' AS tags, meta_is_seen AS is_seen FROM m")
def import_emlx(spark, sf_dir):
    """A file a mail: its length, the message, a property list with its flags."""
    plist = F.concat(F.lit("<plist><dict><key>flags</key><integer>"), F.when(F.col("meta_is_seen"), "8590195713").otherwise("8590195712"), F.lit("</integer></dict></plist>\n"))
    body = F.concat(F.octet_length("message"), F.lit("      \n"), "message", plist)
    files_of = lambda mails: mails.select(F.concat(F.lit("INBOX.mbox/Messages/"), file_name(), F.lit(".emlx")).alias("name"), body.alias("content"))
    return stored(spark, sf_dir, files_of, "apple").select(*CARRIED, F.array_join("tags", ",").alias("tags"), "is_seen")


@query(f"SELECT {CARRIED_SQL}, '' AS tags, meta_is_seen AS is_seen FROM m")
def import_maildir(spark, sf_dir):
    """Seen mails in the cur folders of dot-folders, the others in new."""
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    name, folder = F.replace("path", F.lit("/"), F.lit("-")), F.repeat(F.concat(F.lit(".Work"), number % 20, F.lit("/")), (number % 3 + 1).cast("int"))
    place = F.when(F.col("meta_is_seen"), F.concat(F.lit("box/"), folder, F.lit("cur/"), name, F.lit(":2,RS"))).otherwise(F.concat(F.lit("box/new/"), name))
    files_of = lambda mails: mails.select(place.alias("name"), F.col("message").alias("content"))
    return stored(spark, sf_dir, files_of, "maildir", "/box").select(*CARRIED, F.array_join("tags", ",").alias("tags"), "is_seen")


@query(f"SELECT {CARRIED_SQL}, meta_tags AS tags, meta_is_seen AS is_seen FROM m")
def import_gmail(spark, sf_dir):
    """Every second message is packed by gzip; all have a sidecar."""
    note = F.to_json(F.struct(
        F.col("path").alias("msg_id"), "subject", F.split("meta_tags", r":\|:").alias("labels"),
        F.when(F.col("meta_is_seen"), F.array(F.lit("\\Seen"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.unix_timestamp("datetime").alias("internal_date"),
    ))
    ending = F.when(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint") % 2 == 0, ".eml.gz").otherwise(".eml")
    both = F.array(F.struct(F.concat(file_name(), ending).alias("name"), F.col("message").alias("content")), F.struct(F.concat(file_name(), F.lit(".meta")).alias("name"), note.alias("content")))
    files_of = lambda mails: mails.select(F.explode(both).alias("x")).select("x.*")
    return stored(spark, sf_dir, files_of, "gmailvault", files_a_mail=2).select(*CARRIED, F.array_join("tags", ":|:").alias("tags"), "is_seen")


def line_items(spark: SparkSession, path: str) -> DataFrame:
    """A format of one JSON object a line; files below a folder ``trash`` are left out."""
    found = archives.files(spark, path, "*.txt", where=lambda p: ~F.contains(p, F.lit("/trash/")))
    lines = found.select("path", "length", "modificationTime", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line != ''")
    return archives.raw_rows(lines, F.col("path"), F.col("line").cast("binary"), F.array(F.lit("lines")), F.lit(None).cast("boolean"), "lines")


def parse_lines(raw: DataFrame) -> DataFrame:
    item = "sender_name string, sender_local_part string, sender_domain string, wall string, subject string, to_count bigint, to_group string, to_name string, to_address string, is_reply boolean"
    rows = raw.withColumn("m", F.from_json(F.decode("content", "UTF-8"), item))
    bad = F.col("m.sender_local_part").isNull()
    return rows.select(
        "path", "path_tags", "seen_hint", "format", "m.sender_name", F.concat("m.sender_local_part", F.lit("@"), "m.sender_domain").alias("sender_address"),
        "m.sender_local_part", "m.sender_domain", "m.wall", F.lit(0).alias("zone_seconds"), "m.subject", "m.to_count", "m.to_group", "m.to_name", "m.to_address",
        F.lit(False).alias("reply_to"), F.col("m.is_reply").alias("in_reply_to"), F.when(bad, "parse").alias("stage"), F.when(bad, "ValueError: no sender").alias("error"),
    )


@query(f"SELECT {CARRIED_SQL}, 'lines' AS tags FROM m WHERE CAST(string_split(path, '/')[2] AS BIGINT) % 3 <> 0")
def import_own_format(spark, sf_dir):
    """A format that the library doesn't know, with its reader, a condition on paths, and a parser; every third mail is in a
    folder that the condition leaves out."""
    folder, mails = shared_dir(spark), mail_view(spark, sf_dir)
    item = F.to_json(F.struct(
        "sender_name", "sender_local_part", "sender_domain", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("wall"), "subject",
        F.when(F.col("to_address").isNull(), 0).otherwise(F.col("to_count")).alias("to_count"), "to_group", "to_name", "to_address", "is_reply",
    ))
    third = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint") % 3 == 0
    mails.where(~third).select(item.alias("value")).write.text(f"{folder}/box")
    mails.where(third).select(item.alias("value")).write.text(f"{folder}/trash")
    archives.register_format("lines", line_items, "One a line", parser=parse_lines)
    rows = parse_archive(archives.read_archive(spark, folder, "lines"), own_addresses(spark, sf_dir), parser=archives.PARSERS["lines"])
    return good(rows).select(*CARRIED, F.array_join("tags", ",").alias("tags"))


@query("SELECT 'parse' AS stage, 'ValueError: no valid date' AS message, count(*) AS amount FROM orders WHERE o_orderkey % 10 = 0", mail=False)
def import_errors(spark, sf_dir):
    """From the stored table of errors."""
    path = shared_dir(spark)
    store.write_parsed(parsed_view(spark, sf_dir, break_every=10), path)
    return store.open_errors(spark, path).groupBy("stage", "message").agg(F.count("*").alias("amount"))


@query(
    "SELECT unnest(['done', 'failed', 'read', 'write', 'written']) AS step, unnest([a, b, a, a - b, a - b]) AS n "
    "FROM (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS b FROM orders)",
    mail=False,
)
def import_counts(spark, sf_dir):
    """What an import says of its progress; the last word on each step."""
    told: dict[str, int] = {}
    store.write_parsed(parsed_view(spark, sf_dir, break_every=10), shared_dir(spark), progress=told.__setitem__)
    return spark.createDataFrame(sorted(told.items()), "step string, n bigint")


@query("SELECT path, c_own IS NOT NULL AS own FROM m LEFT JOIN (SELECT DISTINCT lower(replace(c_name, '#', '_')) AS c_own FROM customer WHERE c_custkey % 50 = 0) ON sender_local_part = c_own")
def sender_membership(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 50 = 0").select(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("address"))
    return Q.membership(mail_view(spark, sf_dir), "sender_local_part", own, "address", "own").select("path", "own")


# --- the same operators on other tables, through a field map

DOCUMENTS = FieldMap({"sender_domain": "lang", "sender_local_part": "source", "subject": "text"}, {"sender_domain": "text"})
EVENTS = FieldMap({"year": lambda: F.year("ts"), "month": lambda: F.month("ts"), "day": lambda: F.dayofmonth("ts"), "sender_domain": "event_type"})


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('THTI'))", mail=False)
def contains_documents(spark, sf_dir):
    return P.where(spark.read.parquet(f"{sf_dir}/documents.parquet"), [P.contains("subject", "THTI")], DOCUMENTS).select("doc_id")


@query("SELECT lang AS sender_domain, count(*) AS amount FROM documents GROUP BY lang", mail=False)
def segments_documents_lang(spark, sf_dir):
    return Q.segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), "sender_domain", fields=DOCUMENTS)


@query("SELECT CAST(day(ts) AS INT) AS day, count(*) AS amount FROM events GROUP BY 1", mail=False)
def events_by_day(spark, sf_dir):
    return Q.segments(spark.read.parquet(f"{sf_dir}/events.parquet"), "day", fields=EVENTS)


# --- the store

@query("SELECT year, count(*) AS amount, CAST(sum(to_count) AS BIGINT) AS recipients FROM m WHERE o_ok GROUP BY year".replace("o_ok", "CAST(string_split(path, '/')[2] AS BIGINT) % 10 <> 0"))
def stored_archive(spark, sf_dir):
    """Parsed, written by year with the failures aside, opened again."""
    path = shared_dir(spark)
    store.write_parsed(parsed_view(spark, sf_dir, break_every=10), path)
    return store.open_emails(spark, path).groupBy("year").agg(F.count("*").alias("amount"), F.sum("to_count").alias("recipients"))


@query("SELECT DISTINCT concat(sender_local_part, '@', sender_domain) AS address FROM (SELECT lower(replace(c_name, '#', '_')) AS sender_local_part, concat(lower(replace(n_name, '_', '-')), '.example') AS sender_domain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0)", mail=False)
def config_round_trip(spark, sf_dir):
    """The own addresses of an archive, saved with its settings and loaded."""
    config = store.Config(shared_dir(spark), "mails", "maildir", tuple(r["address"] for r in own_addresses(spark, sf_dir).collect()))
    store.save_config(spark, config)
    loaded = store.load_config(spark, config.database_path)
    return spark.createDataFrame([(x,) for x in loaded.sender_emails], "address string")


@query(f"SELECT {CARRIED_SQL}, 'drop' AS tags FROM m")
def incremental_import(spark, sf_dir):
    """The view as mbox files in two drops, each imported when it is there; a third run finds nothing new."""
    folder, path, mails = shared_dir(spark), shared_dir(spark), written(spark, mail_view(spark, sf_dir))
    own = written(spark, own_addresses(spark, sf_dir))
    for drop in (0, 1):
        part = mails.where(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint") % 2 == drop)
        mbox_lines(part).write.mode("append").text(f"{folder}/drop{drop}.mbox")
        import_new(spark, folder, path, own, name="mbox")
    import_new(spark, folder, path, own, name="mbox")
    return open_imported(spark, path).select(*CARRIED, F.regexp_replace(F.array_join("tags", ","), "^part-.*$", "drop").alias("tags"))


@query(f"SELECT {CARRIED_SQL} FROM m")
def import_whole_and_new(spark, sf_dir):
    """One folder imported as it arrives, another as a whole, which replaces what was there, then the first once more; and
    the second as it arrives, where nothing is new. Each mail is stored once."""
    a, b, path, own = shared_dir(spark), shared_dir(spark), shared_dir(spark), written(spark, own_addresses(spark, sf_dir))
    mails = written(spark, mail_view(spark, sf_dir))
    even = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint") % 2 == 0
    boxes = boxes_of(mails, 8) // 2
    write_mailboxes(mails.where(even), a, boxes)
    write_mailboxes(mails.where(~even), b, boxes)
    import_new(spark, a, path, own, name="mbox")
    store.write_parsed(parse_archive(archives.read_archive(spark, b, "mbox"), own, parts=True), path)
    import_new(spark, a, path, own, name="mbox")
    import_new(spark, b, path, own, name="mbox")
    return open_imported(spark, path).select(*CARRIED)


@query(f"SELECT {CARRIED_SQL} FROM m")
def import_growing_mbox(spark, sf_dir):
    """Mailboxes to whose ends mails are added twice, imported each time."""
    folder, path, own, mails = shared_dir(spark), shared_dir(spark), own_addresses(spark, sf_dir), mail_view(spark, sf_dir)
    boxes = boxes_of(mails, 7)
    for until in ("1996-01-01", "1997-06-01", "2100-01-01"):
        write_mailboxes(mails.where(F.col("datetime") < until), folder, boxes)
        import_new(spark, folder, path, own, name="mbox")
    return open_imported(spark, path).select(*CARRIED)


@query(
    "SELECT year, sender_domain, sender_local_part, month, day, CAST(count(*) AS BIGINT) AS amount, CAST(CASE WHEN grouping(year) = 1 THEN 0 "
    "WHEN grouping(sender_domain) = 1 THEN 1 WHEN grouping(sender_local_part) = 1 THEN 2 WHEN grouping(month) = 1 THEN 3 "
    "WHEN grouping(day) = 1 THEN 4 ELSE 5 END AS INT) AS level FROM m GROUP BY ROLLUP (year, sender_domain, sender_local_part, month, day)"
)
def stored_cube(spark, sf_dir):
    """All drill-down levels after three imports, from the counts that each has left; no mail is read."""
    path, own, mails = shared_dir(spark), written(spark, own_addresses(spark, sf_dir)), written(spark, mail_view(spark, sf_dir))
    third = F.pmod(F.xxhash64("path"), F.lit(3))
    for i in range(3):
        part = mails.where(third == i).select("*", message_text().alias("message"))
        store.write_parsed(parse_archive(raw_of(part), own), path, batch=f"part-{i}")
    return Q.drill_cube(store.open_cells(spark, path), weight="amount")


@query("SELECT CAST(row_number() OVER (ORDER BY datetime, path) - 1 AS BIGINT) AS place, path, subject FROM m QUALIFY place >= 7000 AND place < 7100")
def page_random(spark, sf_dir):
    """A page in the middle of a ranked table, which reads the ranges that it lies in."""
    path = shared_dir(spark)
    Q.write_ranked(FIELDS.select(mail_view(spark, sf_dir), "datetime", "path", "subject"), path, range_rows=1500)
    return Q.ranked_page(spark, path, 7000, 7100).select("place", "path", "subject")


@query("SELECT path, array_to_string(list_filter(string_split(coalesce(meta_tags, ''), ':|:'), lambda x: x <> ''), ':|:') AS tags FROM m")
def tags_round_trip(spark, sf_dir):
    """Tags split from their joined text and joined again."""
    return mail_view(spark, sf_dir).select("path", join_tags(split_tags(F.concat_ws(TAG_SEPARATOR, "meta_tags"))).alias("tags"))


@query()
def synthetic_mails_by_domain(spark, sf_dir):
    """Customers as senders, their nations as domains."""
    customers, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    people = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(F.col("c_custkey").alias("sender"), F.lower("c_name").alias("local_part"), F.col("c_name").alias("name"), F.concat(F.lower("n_name"), F.lit(".example")).alias("domain"))
    return Q.segments(synthetic_mails(spark, people=people), "sender_domain")

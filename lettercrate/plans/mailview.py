"""A mail-shaped view over the test tables, as SQL that Spark and DuckDB both run, and its parts as mail text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.plans.fields import FieldMap, split_tags

TABLES = ("orders", "customer", "nation", "lineitem", "supplier")

MAIL_SQL = """
  SELECT concat('orders/', CAST(o_orderkey AS STRING)) AS path,
    concat(lower(replace(n_name, '_', '-')), '.example') AS sender_domain,
    lower(replace(c_name, '#', '_')) AS sender_local_part, c_name AS sender_name, o_orderdate AS datetime,
    CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
    concat(CASE WHEN o_orderstatus = 'F' THEN 'Re: ' ELSE '' END, 'Order ', CAST(o_orderkey AS STRING), ' ', o_orderpriority) AS subject,
    CAST(coalesce(rcpt.n, 0) AS BIGINT) AS to_count,
    CASE WHEN rcpt.n >= 6 THEN concat('group-', CAST(rcpt.n AS STRING)) END AS to_group,
    s_name AS to_name,
    CASE WHEN s_name IS NOT NULL THEN concat(lower(replace(s_name, '#', '_')), '@suppliers.example') END AS to_address,
    o_orderstatus = 'F' AS is_reply, c_custkey % 50 = 0 AS is_send,
    concat(o_orderpriority, ':|:', c_mktsegment) AS meta_tags, o_orderstatus <> 'O' AS meta_is_seen
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) rcpt ON o_orderkey = l_orderkey
    LEFT JOIN supplier ON sk = s_suppkey
"""

#: The view's joined tags are split once; its seen flag has another name.
FIELDS = FieldMap({"tags": lambda: split_tags(F.col("meta_tags")), "is_seen": "meta_is_seen", "timestamp": lambda: F.unix_timestamp("datetime")})


def mail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mail an order. A column that a query doesn't read costs neither its scan nor its join's columns."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = MAIL_SQL
    for name in TABLES:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **tables)


def with_mail(sql: str) -> str:
    """A DuckDB query over the view, called m."""
    return f"WITH m AS ({MAIL_SQL}) {sql}"

"""Synthetic mails for demonstrations: a skewed sender population, deterministic in its seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_mails(
    spark: SparkSession, n_senders: int = 0, seed: int = 0, clustered: float = 0.3, start: str = "2000-01-01", days: int = 7300, people: DataFrame | None = None
) -> DataFrame:
    """One mail from each sender, and 5 to 50 further ones from about ``clustered`` of them.

    people: the senders (sender, a number; local_part, name, domain); without it n_senders are made up.
    """

    def draw(name: str, n: int, *more):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "sender", *more), F.lit(n))

    if people is None:
        people = spark.range(n_senders).withColumnRenamed("id", "sender").withColumns({
            "local_part": F.concat(F.lit("sender_"), "sender"),
            "name": F.concat(F.lit("Sender "), "sender"),
            "domain": F.concat(F.lit("host"), draw("domain", max(1, n_senders // 20)), F.lit(".example")),
        })
    extra = F.when(draw("cluster", 1000) < int(clustered * 1000), 5 + draw("more", 46)).otherwise(F.lit(0))
    mails = people.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), extra)))
    when = F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + draw("second", days * 86400, "number"))
    mails = mails.withColumn("datetime", when)
    return mails.select(
        F.concat(F.lit("synthetic/"), "sender", F.lit("/"), "number").alias("path"),
        F.col("domain").alias("sender_domain"),
        F.col("local_part").alias("sender_local_part"),
        F.col("name").alias("sender_name"),
        "datetime",
        F.year("datetime").alias("year"),
        F.month("datetime").alias("month"),
        F.dayofmonth("datetime").alias("day"),
        F.unix_seconds("datetime").alias("timestamp"),
        F.concat(F.lit("Message "), "number").alias("subject"),
        (draw("reply", 10, "number") == 0).alias("is_reply"),
        (draw("send", 20, "number") == 0).alias("is_send"),
    )

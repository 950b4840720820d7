"""Small pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting (tests on one machine) a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lettercrate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: later jobs start from files, not from its lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again; what other frames are read from later must stay."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Blocks of scripts that are written without spaces between words: Thai and Lao, Burmese, Khmer, kana, Han. As ranges of
#: code points, which a regular expression tells apart much faster than names of scripts.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"


def tokens_of(text: Column) -> Column:
    """The words of a text; in scripts without spaces, every letter. None for a null text."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({UNSPACED})", " $1 "), WHITE), "")


def words_of(text: Column) -> Column:
    """The words of a text (runs of anything but white space); none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Secret scans over an incremental ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its content (its blob). The ledger, a folder of
Parquet files, holds for each blob the rule versions that it was scanned with and what they found. A scan reads only
blobs with a rule version that the ledger doesn't have for them, adds what it finds, and joins the findings of all
rules back to every path and version that has the blob. Equal contents are scanned once, however many paths have them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, written

#: Most unseen blobs whose addresses are broadcast (some 10 MB), to leave all other texts unshuffled.
FEW_BLOBS = 100_000

LEDGER = "blob string, versions array<string>, findings array<struct<kind:string,version:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has least characters or more; folds: ASCII case."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    folds: bool = False

    @property
    def version(self) -> str:
        facts = "\0".join(map(str, (self.kind, self.pattern, self.least, self.group, self.folds)))
        return f"{self.kind}@{hashlib.sha256(facts.encode()).hexdigest()[:12]}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.folds else re.ASCII)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Widely published formats of keys; they add to the base rules. Each reads a text in linear time: a match starts only
#: where a token starts, runs don't give characters back, or lengths are bounded.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+!$&*=-]{3,128}@"),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger_of(spark: SparkSession, root: str) -> DataFrame:
    """The ledger's rows; none where it doesn't exist yet."""
    try:
        return spark.read.schema(LEDGER).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _scan(rules: tuple[Rule, ...]):
    """For mapInArrow: blob, text, todo (numbers of rules) to ledger rows."""

    def per_batch(batches):
        patterns = [r.compiled() for r in rules]
        # a run of fewer characters can't pass, and trying it out costs most of the time
        fast = {i: re.compile(r"[0-9a-f]{%d,}" % r.least) for i, r in enumerate(rules) if r.pattern == r"[0-9a-f]+"}
        kind = pa.struct([("kind", pa.string()), ("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            blobs, todos = batch.column(0), batch.column(2).to_pylist()
            versions, findings = [], []
            for text, todo in zip(batch.column(1).to_pylist(), todos, strict=True):
                found = []
                for i in todo:
                    rule = rules[i]
                    for m in fast.get(i, patterns[i]).finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found.append({"kind": rule.kind, "version": rule.version, "start": m.start(), "end": m.end()})
                versions.append([rules[i].version for i in todo])
                findings.append(found)
            columns = [blobs, pa.array(versions, pa.list_(pa.string())), pa.array(findings, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["blob", "versions", "findings"])

    return per_batch


def update_ledger(contents: DataFrame, root: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the unseen (blob, rule version) pairs of contents (column text; null: empty), adds them to the ledger at
    ``root`` and returns the ledger.

    Rows are appended by one job, whose files count once all are there. A run that broke off can be repeated: it scans
    what is still unseen.
    """
    spark = contents.sparkSession
    none = F.array().cast("array<string>")
    known = ledger_of(spark, root).groupBy("blob").agg(F.flatten(F.collect_list("versions")).alias("seen"))
    texts = contents.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    # which pairs are unseen is found out with addresses alone
    asked = texts.select("blob").distinct().join(known, "blob", "left").withColumn("seen", F.coalesce("seen", none))
    numbers = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.version).alias("v")) for i, r in enumerate(rules)])
    todo = F.transform(F.filter(numbers, lambda x: ~F.array_contains("seen", x["v"])), lambda x: x["i"])
    unseen = written(asked.select("blob", todo.alias("todo")).where(F.size("todo") > 0))
    count = unseen.count()
    if count:
        if count <= FEW_BLOBS:  # few new blobs: the texts of all others stay where they are
            texts = texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
        work = texts.dropDuplicates(["blob"]).join(unseen, "blob").select("blob", "text", "todo")
        work.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(root)
    discard(unseen)
    return ledger_of(spark, root)


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and findings, an array of (kind, start, end) in code points by start and then by the order of the rules,
    for blobs in which the given rules' versions found anything."""
    numbers = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.version).alias("v")) for i, r in enumerate(rules)])
    found = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"))
    found = found.withColumn("rule", F.get(F.filter(numbers, lambda x: x["v"] == F.col("f.version")), F.lit(0))["i"]).where("rule is not null")
    entry = F.struct("f.start", "rule", "f.end", "f.kind")
    found = found.groupBy("blob").agg(F.sort_array(F.collect_set(entry)).alias("all"))
    return found.select("blob", F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of versions: its columns without text, blob, and findings as in findings_of, or an empty
    array. Columns that are named blob or findings are replaced.

    Only blobs with findings are in the join, one short row each; a hot blob's paths are split by Spark's skew-join.
    """
    refs = versions.withColumn("blob", blob_of(F.col("text"))).drop("text", "findings")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return refs.join(findings_of(ledger, rules), "blob", "left").withColumn("findings", F.coalesce("findings", none))


def as_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """docs with every finding in text replaced by ``mark`` (overlapping or touching ones by one together) and n_chars,
    where there is such a column, counted anew. Rows without findings stay as they are, null texts included; so do all
    other columns, whatever their names. Repeated rows are treated alike; no rows give no rows."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(body, a, b):
            out, at = [], 0
            for start, end in zip(a, b, strict=True):
                if start > at or not at:
                    out += [body[at:start], mark]
                at = max(at, end)
            return "".join([*out, body[at:]])

        return pd.Series([one(*x) if x[1] is not None and len(x[1]) else x[0] for x in zip(text, starts, ends, strict=True)], dtype=object)

    found = findings_of(ledger, rules).select("blob", F.col("findings.start").alias("starts"), F.col("findings.end").alias("ends"))
    # a row travels as one column, so its names meet no others
    rows = docs.select(blob_of(F.col("text")).alias("address"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(found, F.col("address") == F.col("blob"), "left").select("row", "starts", "ends", clean("row.text", "starts", "ends").alias("cleaned"))
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        n_chars = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("starts").isNull(), F.col("row.n_chars")).otherwise(n_chars)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

"""Mixing sources by temperature.

A source's weight is its share of tokens to the power ``exponent``, normalised: 1 keeps the shares, 0 makes all equal.
The exponent is found by bisection, the largest that reaches a target entropy, raised again if a source would then be
repeated more than ``most_epochs`` times. Weights become budgets of tokens. A source is read in epochs, each a
permutation of its documents by a keyed hash, until its budget is used up; its stream is cut into blocks in which
every source has its weight's worth of tokens, and rows are permuted within a block.

Streams are running sums of tokens. They are computed in two steps, within ranges of the hash and over the sums of
these ranges, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettercrate.llm.common import words_of

RANKED_TOGETHER = 5_000
#: A mixture has a weight for each source; its table of weights is made on the driver and broadcast.
MOST_SOURCES = 100_000


def tokens_of(text: Column) -> Column:
    """Words of a text, 1 at least."""
    return F.greatest(F.size(words_of(text)), F.lit(1)).cast("long")


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def epochs_of(tokens: dict, weights: dict, budget: float | None) -> dict:
    """How often each source is read. Without a budget: the least budget that reads each source once at least."""
    budget = budget or max(n / weights[s] for s, n in tokens.items())
    return {s: budget * weights[s] / n for s, n in tokens.items()}


def find_exponent(tokens: dict, target_entropy: float | None, most_epochs: float | None, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in 0..1. target_entropy: as a part of the largest possible one, that of equal weights.

    Entropy falls and repetition of the rarest source falls as the exponent rises, so both are bisected. A limit on
    repetition goes before the target; a limit that even exponent 1 exceeds gives 1. Without a target, weights are as
    even as the limit allows; without either they are the shares.
    """

    def highest(holds) -> float:
        low, high = 0.0, 1.0
        if holds(1.0):
            return 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    def lowest(holds) -> float:
        low, high = 0.0, 1.0
        if holds(0.0):
            return 0.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    exponent = 1.0 if most_epochs is None else 0.0
    if target_entropy is not None and len(tokens) > 1:
        goal = target_entropy * math.log(len(tokens))
        exponent = highest(lambda a: entropy(weights_at(tokens, a)) >= goal)
    if most_epochs is not None:
        exponent = max(exponent, lowest(lambda a: max(epochs_of(tokens, weights_at(tokens, a), budget).values()) <= most_epochs))
    return exponent


def source_tokens(docs: DataFrame, most_sources: int = MOST_SOURCES) -> list:
    """Rows (source, tokens, n) of docs with source and tokens; one row a source. More than most_sources are refused."""
    rows = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them before mixing")
    return rows


def prepare(docs: DataFrame) -> DataFrame:
    """docs with tokens and key (a hash of id and text), from which mix works; text may be dropped afterwards. Columns
    with these two names are replaced.

    mix reads its rows three times, so they are best written first, without the text where it isn't wanted.
    """
    return docs.withColumns({"tokens": tokens_of(F.col("text")), "key": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))})


def mix(rows: DataFrame, target_entropy: float | None = None, most_epochs: float | None = 2.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 0) -> DataFrame:
    """Rows (from prepare, with doc_id and source) as the mixture reads them: their columns, epoch (from 0), block (from
    0) and block_order (a hash by which rows of a block are permuted; ties are rows that are alike). Columns of rows
    with these three names are replaced, others kept whatever their names.

    Null sources are one source of their own; a null or empty text counts one token. A row is read if its source's
    stream before it holds less than the budget, so a source ends with the row that reaches its budget. Without a
    budget each row is read at least once. Repeated rows are rows of their own. No rows give no rows.
    """
    rows = rows.drop("epoch", "block", "block_order")
    spark = rows.sparkSession
    sums = {r["source"]: (r["tokens"], r["n"]) for r in source_tokens(rows)}
    table = []
    if sums:
        tokens = {s: t for s, (t, _) in sums.items()}
        weights = weights_at(tokens, find_exponent(tokens, target_entropy, most_epochs, budget))
        for number, (s, e) in enumerate(epochs_of(tokens, weights, budget).items()):
            # a hair less, lest rounding starts an epoch for nothing
            table.append((number, s, max(1, math.ceil(e - 1e-9)), e * tokens[s] * (1 - 1e-12), weights[s] * block_tokens, -(-sums[s][1] // RANKED_TOGETHER)))
    table = spark.createDataFrame(table, "number int, name string, epochs int, budget double, per_block double, ranges int")
    # the row travels as one column, so its names meet no others
    rows = rows.select("doc_id", "source", "tokens", "key", F.struct(*rows.columns).alias("row"))
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "epoch", "key"))
    # the top bits of the hash, so that ranges follow each other in its order
    rows = rows.withColumn("range", F.floor((F.shiftright("hash", 32) + (1 << 31)) * F.col("ranges") / (1 << 32)).cast("int"))
    by = ["number", "epoch", "range"]
    before = Window.partitionBy("number").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*by).agg(F.sum("tokens").alias("sum"))
    ranges = ranges.select(*by, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*by).orderBy("hash", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(ranges, by)
    rows = rows.withColumn("at", F.col("before") + F.col("base")).where("at < budget")
    block = F.floor(F.col("at") / F.col("per_block")).cast("long")
    return rows.select("row.*", "epoch", block.alias("block"), F.xxhash64(F.lit(seed + 1), "hash").alias("block_order"))

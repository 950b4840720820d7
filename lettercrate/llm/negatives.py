"""Hard-negative mining by slots.

Each anchor has up to ``n_positives`` positives, the best rows of its own label; each positive has a window of scores
below its own in which negatives are sought. The windows of an anchor overlap, but their upper limits cut the scores into
disjoint slots. It is enough to keep the best k rows of each slot: the best k below an upper limit are among those of its
slot and the slots under it, merged from the highest down. A combiner in each task keeps k rows a slot, so few rows move.

Scores are of all anchors against all rows, so both are cut into blocks, which meet in a grid: a task multiplies one
block of anchors with one of rows, and nothing but the best rows of its slots leaves it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettercrate.llm.common import written

#: Rows whose vec_id is divisible by this are anchors.
EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: A component is a whole number of 256ths, held within these bounds, so sums of up to 2,048 products fit in 64 bits.
SCALE, MOST = 256, 1 << 26
#: Anchors and rows of a cell of the grid, and rows that are multiplied at a time.
ANCHORS, ROWS, AT_ONCE = 1024, 4096, 1024


def prepared(rows: DataFrame) -> DataFrame:
    """row (a number), vec_id, label and v (whole numbers), written once: rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    v = F.transform("embedding", lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(SCALE * x.cast("double")).cast("double"))).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint"), label.cast("bigint").alias("label"), v.alias("v")))


def _matrix(column, width: int):
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    import numpy as np

    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(a, b):
    """Whole-number inner products: by floating point where no sum can exceed what a double holds exactly."""
    import numpy as np

    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 1 << 53 else a @ b.T


def _first(k: int, score, ids, *groups):
    """Places of the first k of each group: by falling score, then rising id."""
    import numpy as np

    order = np.lexsort((ids, -score, *groups))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _grid(anchors: DataFrame, rows: DataFrame, k: int, slots: int, choose) -> DataFrame:
    """anchor (its row), slot, vec_id, score: the first k rows of each slot in each cell.

    choose(anchors, scores, rows) gives the slot of each pair of a block of scores, below 0 where there is none; it gets
    the columns of both sides as dictionaries of arrays.
    """
    n_anchors, n_rows = (max(1, -(-df.count() // size)) for df, size in ((anchors, ANCHORS), (rows, ROWS)))
    cell = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select("*", cell(n_anchors).alias("i"), every(n_rows).alias("j"))
    b = rows.select("*", every(n_anchors).alias("i"), cell(n_rows).alias("j"))
    a, b = (df.toDF(*df.columns) for df in (a, b))  # columns of their own, as anchors are among the rows

    def per_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        width = max([0, *(x for t in (left, right) if t.num_rows for x in [pa.compute.max(pa.compute.list_value_length(t["v"])).as_py() or 0])])
        right = right.take(pa.compute.sort_indices(right["vec_id"]))
        plain = lambda t: {c: t[c].to_numpy() for c in ("row", "vec_id", "label")} | {"limits": np.array(t["limits"].to_pylist(), np.int64).reshape(t.num_rows, -1) if "limits" in t.column_names else None}
        x, y, mine, theirs = _matrix(left["v"], width), _matrix(right["v"], width), plain(left), plain(right)
        least = np.full((left.num_rows, slots), np.iinfo(np.int64).min)  # the k-th best so far
        kept = [np.empty(0, np.int64)] * 4
        for start in range(0, right.num_rows if left.num_rows else 0, AT_ONCE):
            some = {c: v[start : start + AT_ONCE] for c, v in theirs.items() if v is not None}
            scores = _products(x, y[start : start + AT_ONCE])
            slot = choose(mine, scores, some)
            at, there = np.nonzero((slot >= 0) & (scores >= np.take_along_axis(least, np.maximum(slot, 0), axis=1)))
            new = [at, slot[at, there], scores[at, there], some["vec_id"][there]]
            kept = [np.concatenate(p) for p in zip(kept, new, strict=True)]
            best = _first(k, kept[2], kept[3], kept[1], kept[0])
            kept = [c[best] for c in kept]
            full = np.zeros((left.num_rows, slots), np.int64)
            np.add.at(full, (kept[0], kept[1]), 1)
            low = np.full_like(least, np.iinfo(np.int64).max)
            np.minimum.at(low, (kept[0], kept[1]), kept[2])
            least = np.where(full >= k, low, least)
        return pa.table({"anchor": pa.array(mine["row"][kept[0]], pa.int64()), "slot": pa.array(kept[1], pa.int32()), "vec_id": pa.array(kept[3], pa.int64()), "score": pa.array(kept[2], pa.int64())})

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(per_cell, "anchor bigint, slot int, vec_id bigint, score bigint")
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _upper(score: Column, high: int) -> Column:
    """The greatest whole score of a window; whole numbers throughout, also below 0."""
    hundredths = high * score
    return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100))


def positives(anchors: DataFrame, rows: DataFrame, n: int = POSITIVES) -> DataFrame:
    """anchor, positive_id, positive_score: the first n other rows of an anchor's label."""

    def same_label(mine, scores, theirs):
        import numpy as np

        return np.where((mine["label"][:, None] == theirs["label"]) & (mine["vec_id"][:, None] != theirs["vec_id"]), 0, -1)

    return _grid(anchors, rows, n, 1, same_label).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def mine(rows: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its
    positives the first n_negatives rows of another label whose score has low * positive <= 100 * score <= high * positive.

    rows has vec_id, embedding and label; other columns are ignored. Rows with a null in these, or with a component that
    is null or not finite, take no part. Rows that share a vec_id are rows of their own, but never positives or negatives
    of each other's anchors: a repeated anchor is answered as often as it stands there. Shorter vectors count as filled up
    with zeros; a component beyond 262,144 in size counts as that. Equal scores come by ascending vec_id. An anchor
    without positives, or a positive without negatives, gives no rows, nor does an empty table.
    """
    table = prepared(rows)
    anchors = table.where(F.col("vec_id") % every == 0)
    good = written(positives(anchors, table, n_positives).withColumn("upper", _upper(F.col("positive_score"), high)))
    limits = good.groupBy("anchor").agg(F.sort_array(F.collect_list("upper")).alias("limits"), F.min("positive_score").alias("least"))  # at most n_positives each
    # the limits of an anchor in rising order, filled up with the greatest; last the lowest score of any window, in hundredths
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda i: F.coalesce(F.get("limits", i.cast("int")), F.array_max("limits")))
    limits = limits.select(F.col("anchor").alias("row"), F.concat(filled, F.array(low * F.col("least"))).alias("limits"))

    def windows(mine, scores, theirs):
        import numpy as np

        slot = np.zeros(scores.shape, np.int64)
        for i in range(n_positives):
            slot += scores > mine["limits"][:, i, None]
        out = (slot == n_positives) | (100 * scores < mine["limits"][:, -1, None])
        return np.where(out | (mine["label"][:, None] == theirs["label"]) | (mine["vec_id"][:, None] == theirs["vec_id"]), -1, slot)

    slots = _grid(anchors.join(limits, "row"), table, n_negatives, n_positives, windows)
    falling = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("vec_id").alias("negative_id")))).alias("falling"))  # n_negatives a slot
    below = F.slice(F.filter("falling", lambda x: -x["down"] <= F.col("upper")), 1, n_negatives)
    chosen = F.filter(below, lambda x: F.lit(low) * F.col("positive_score") <= -100 * x["down"])
    found = good.join(falling, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(chosen).alias("place", "x"))
    found = found.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.negative_id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))

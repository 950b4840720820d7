"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a row of Hamming distances to many reference fingerprints (pivots). If x and y differ
in at most r bits, their distances to every pivot differ by at most r, so a pair whose largest coordinate difference
exceeds r is discarded without comparing fingerprints; survivors are verified bit by bit.

Which pairs are looked at: of two fingerprints that differ in at most r bits one of r + 1 bands of bits is equal, and so
is one of r + 1 bands of the remaining bits. Pairs are joined on an equal pair of bands (over half of all bits) and an
equal or neighbouring cell of one pivot coordinate, so nothing is compared with everything; pivot tables then discard,
and bits verify. Should more than ``crowd`` distinct fingerprints share such a pair of bands, pairing them off would be
quadratic; for r = 2 there is an exact way for those: two fingerprints are linked exactly if a third lies within one bit
of both, so each names its 65 neighbours, and those that name the same one are paired with the least of them. These
pairs go through the same tables and the same verification.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, written

RADIUS = 2
#: Reference fingerprints: words of the SplitMix64 sequence, a fixed rule.
N_PIVOTS = 24
CELL = 4
#: Most distinct fingerprints with an equal pair of bands that are paired off.
CROWD = 2048
#: A key with more than one in so many rows is hot: there are fewer hot keys than this, so they may be broadcast.
HOT = 1000


def pivots(n: int = N_PIVOTS) -> list[int]:
    """n signed 64-bit reference fingerprints, from the SplitMix64 sequence that starts at 0."""
    mask, state, out = (1 << 64) - 1, 0, []
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """docs without its text and with ``fingerprint`` (bigint): bits set in over half the hashes of its shingles.

    Letters A to Z count as lower case. A text of fewer than ``width`` words has one shingle, the whole sequence; a
    null text or one without words has fingerprint 0.
    """
    at = docs.columns.index(text)
    schema = docs.drop(text).withColumn("fingerprint", F.lit(0).cast("bigint")).schema

    def per_batch(batches):
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(body: bytes | None) -> int:
            words = (body or b"").lower().split()  # of bytes: A-Z only, and the white space of the contract
            if not words:
                return 0
            joined, starts, ends, place = b" ".join(words), [], [], 0
            for w in words:
                starts.append(place)
                place += len(w)
                ends.append(place)
                place += 1
            k = min(width, len(words)) - 1
            h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k:], strict=False)], dtype="<u8")
            total = np.zeros(64, dtype=np.int64)
            for i in range(0, len(h), 1 << 14):
                total += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])

        for batch in batches:
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            found = pa.array([one(x.as_py()) for x in batch.column(at).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*names, "fingerprint"])

    return docs.mapInArrow(per_batch, schema)


def _table(fingerprint: Column) -> Column:
    """Distances to all pivots, in order."""
    return F.array(*[F.bit_count(fingerprint.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots()])


def _masks(radius: int) -> list[int]:
    """Masks of the pairs of bands: a band of 64 bits, and a band of the bits outside it, as signed numbers."""

    def bands(bits: list[int]) -> list[list[int]]:
        cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
        return [bits[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    out = []
    for outer in bands(list(range(64))):
        for inner in bands([x for x in range(64) if x not in outer]):
            mask = sum(1 << x for x in (*outer, *inner))
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(marks: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: edges between distinct fingerprints of marks (column fingerprint; nulls are left out) whose
    connected components are those of all pairs within ``radius`` bits. Each edge is such a pair.

    For another radius than 2 crowded groups have no way of their own and are paired off like the others.
    """
    f = F.col("fingerprint")
    bands = F.array(*[F.struct(F.lit(i).alias("band"), f.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(radius))])
    rows = marks.select("fingerprint").where("fingerprint is not null").distinct()
    rows = rows.withColumn("x", F.explode(bands)).select("fingerprint", "x.*")
    sizes = rows.groupBy("band", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(sizes, ["band", "bits"]))

    few = (rows.where(F.col("n") <= crowd) if radius == 2 else rows).select("band", "bits", "fingerprint", _table(f).alias("table"))
    cell = F.floor(F.get("table", F.lit(0)) / CELL).cast("int")
    a = few.select("band", "bits", F.col("fingerprint").alias("a"), F.col("table").alias("ta"), cell.alias("cell"))
    b = few.select("band", "bits", F.col("fingerprint").alias("b"), F.col("table").alias("tb"), F.explode(_cells(F.get("table", F.lit(0)), radius)).alias("cell"))
    near = F.lit(True)
    for i in range(N_PIVOTS):
        near = near & (F.abs(F.get("ta", F.lit(i)) - F.get("tb", F.lit(i))) <= radius)
    # near stands first, so that pivots discard pairs before fingerprints are compared
    kept = near & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    pairs = a.join(b, ["band", "bits", "cell"]).where((F.col("a") < F.col("b")) & kept).select("a", "b")
    if radius != 2:
        return pairs.distinct()

    crowded = rows.where(F.col("n") > crowd).select("fingerprint").distinct()
    around = F.array(f, *[f.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    named = crowded.select("fingerprint", F.explode(around).alias("point"))
    least = named.groupBy("point").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = named.join(least, "point").where(f > F.col("a")).select("a", f.alias("b")).distinct()
    stars = stars.select("a", "b", _table(F.col("a")).alias("ta"), _table(F.col("b")).alias("tb")).where(kept).select("a", "b")
    return pairs.unionByName(stars).distinct()


def _cells(distance: Column, radius: int) -> Column:
    """The cells of a pivot coordinate that hold any distance within radius of this one."""
    return F.array_distinct(F.array(*[F.floor((distance + d) / CELL).cast("int") for d in range(-radius, radius + 1, min(CELL, radius))]))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of edges (a, b) the least node of its connected component.

    Rounds of large-star and small-star joins until no edge changes; the number of rounds grows with the logarithm
    of the diameter. Each round reads the table that the one before has written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = _sum(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        before, seen = seen, _sum(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _sum(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 30))), F.lit(0))).first())


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table on key. table has each key of rows once, and n, the number of its rows, which is dropped.

    Rows of hot keys meet a broadcast of fewer than HOT rows, so no task gets a hot key's rows all together.
    """
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > total
    hot = table.where(is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _rooted(marks: DataFrame, least, radius: int) -> tuple[DataFrame, DataFrame]:
    """(a written table of fingerprint, root, n and least, one row a fingerprint; the same by root, one row a root).

    marks: a written table with fingerprint; least: an aggregate over the rows of a fingerprint whose least value is
    wanted; root: the least fingerprint of the component.
    """
    own = marks.groupBy("fingerprint").agg(least.alias("least"), F.count("*").alias("n"))
    roots = components(links(marks, radius))
    own = own.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least", "n")
    own = written(own)
    return own, written(own.groupBy("root").agg(F.min("least").alias("chosen"), F.count("*").alias("n")))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, the least doc_id linked to it
    over any number of links of at most ``radius`` bits.

    docs has doc_id and text; other columns are ignored. Repeated rows get equal rows; a null doc_id is a document whose
    id is never the least unless all are null. No rows give no rows.
    """
    marks = written(fingerprints(docs.select("doc_id", "text"), width))
    own, roots = _rooted(marks, F.min("doc_id"), radius)
    named = looked_up(own.select("fingerprint", "root", F.col("n").alias("rows")), roots, "root")
    named = written(named.select("fingerprint", F.col("chosen").alias("component_id"), F.col("rows").alias("n")))
    out = looked_up(marks, named, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates, with all columns, whatever their names: of each component the row with the least
    doc_id stays (then the least hash of its text), one if several share both.

    A row without an id counts as having one of its own, above all others and the same for equal texts. No rows give
    no rows.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.lit(1 << 62) + F.pmod(mark, F.lit(1 << 61))
    rows = docs.select(F.coalesce("doc_id", own).alias("id"), mark.alias("hash"), "text", F.struct(*docs.columns).alias("row"))
    marks = written(fingerprints(rows.select("id", "hash", "text"), width))
    kept = _rooted(marks, F.min(F.struct("id", "hash")), radius)[1].select("chosen.*")
    return rows.drop("text").join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")

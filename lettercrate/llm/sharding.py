"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, one of some thousand, and never changes. Bytes and rows are summed per slot, and
a versioned map says which shard holds a slot, for every slot there is, in use or not, so it has a shard for any row
that comes later. The first version deals slots to shards by size, largest first to the
lightest shard; later versions edit the one before: only slots that must move do. Moving a slot moves its rows and
nothing else. The map has one row a slot, whatever the number of records, so it is made on the driver and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
MAP = "version int, virtual_slot int, shard int, n_bytes bigint, n_rows bigint"


def with_slots(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """docs with virtual_slot and size (UTF-8 bytes of text, none for null, plus 1); columns with these names are
    replaced. A row without an id is dealt by its text, lest all such rows meet in one slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.xxhash64("doc_id"))
    return docs.withColumns({"virtual_slot": F.pmod(mark, F.lit(n_slots)).cast("int"), "size": size})


def slot_sizes(rows: DataFrame, n_slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(virtual_slot, bytes, rows) of every slot, 0 and 0 for those without rows; n_slots rows on the driver."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    used = {r["virtual_slot"]: (r["b"], r["n"]) for r in sums.collect()}
    return [(slot, *used.get(slot, (0, 0))) for slot in range(n_slots)]


def first_map(sizes: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """Version 1: slots by size, largest first, each to the shard with the fewest bytes so far; of slots without bytes
    each to the shard with the fewest slots."""
    heap = [(0, shard) for shard in range(n_shards)]
    out, held = [], [0] * n_shards
    for slot, size, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if size:
            total, shard = heapq.heappop(heap)
            heapq.heappush(heap, (total + size, shard))
        else:
            shard = min(range(n_shards), key=lambda k: (held[k], k))
        held[shard] += 1
        out.append((1, slot, shard, size, n))
    return sorted(out)


def edited_map(before: list[tuple], sizes: list[tuple[int, int, int]], n_shards: int, slack: float = 0.01) -> list[tuple]:
    """The next version, for new sizes or another number of shards. Slots of shards that are gone, and new slots, go to
    the lightest shards; then slots move from the heaviest to the lightest shard while that one is more than ``slack``
    of the mean below it and some slot makes the two more alike."""
    home = {slot: shard for _, slot, shard, _, _ in before if shard < n_shards}
    load, held = [0] * n_shards, [{} for _ in range(n_shards)]
    facts = {slot: (size, n) for slot, size, n in sizes}
    facts |= {slot: (0, 0) for _, slot, _, _, _ in before if slot not in facts}

    def put(slot: int, shard: int) -> None:
        home[slot] = shard
        held[shard][slot] = facts[slot][0]
        load[shard] += facts[slot][0]

    for slot in sorted(facts):
        if slot in home:
            put(slot, home[slot])
    for slot in sorted(set(facts) - set(home), key=lambda x: (-facts[x][0], x)):
        put(slot, min(range(n_shards), key=lambda k: (load[k], k)))
    mean = sum(load) / n_shards
    while True:
        high, low = max(range(n_shards), key=lambda k: load[k]), min(range(n_shards), key=lambda k: load[k])
        gap = load[high] - load[low]
        slot = max((x for x, size in held[high].items() if 0 < size < gap and size <= gap // 2 + 1), key=lambda x: (held[high][x], -x), default=None)
        if gap <= slack * mean or slot is None or held[high][slot] * 2 > gap + 1:
            break
        load[high] -= held[high].pop(slot)
        put(slot, low)
    version = 1 + max((x[0] for x in before), default=0)
    return [(version, slot, home[slot], *facts[slot]) for slot in sorted(facts)]


def save_map(spark: SparkSession, rows: list[tuple], root: str) -> None:
    """Adds a version of the map to the table at root; earlier versions stay."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.partitionBy("version").mode("append").parquet(root)


def load_map(spark: SparkSession, root: str, version: int | None = None) -> list[tuple]:
    """A version of the map at root, the latest by default."""
    table = spark.read.schema(MAP).parquet(root)
    version = version or table.agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in table.where(F.col("version") == version).select(*[x.split()[0] for x in MAP.split(", ")]).collect())


def _whole(mapping: list[tuple], n_slots: int) -> None:
    """Refuses a map without a shard for some slot, which would lose rows."""
    missing = set(range(n_slots)) - {x[1] for x in mapping}
    if missing:
        raise ValueError(f"the map lacks {len(missing)} of {n_slots} slots, such as {min(missing)}")


def assign(rows: DataFrame, mapping: list[tuple], n_slots: int = SLOTS) -> DataFrame:
    """rows (from with_slots, with doc_id and size) with shard, slot (its number in the shard, from 0 without gaps) and
    map_version; columns with these names are replaced, others kept whatever their names.

    The map says where a virtual slot belongs; how many rows it has is counted here, as the map may stem from other
    rows (counts of at most n_slots slots reach the driver). Rows are numbered within their virtual slot, and each virtual
    slot starts where those before it in its shard end, so no task sees a whole shard. A map that lacks slots is refused.
    No rows give no rows; repeated rows get a number each.
    """
    _whole(mapping, n_slots)
    starts, at = [], {}
    sizes = dict(rows.groupBy("virtual_slot").count().collect())
    for version, slot, shard, _, _ in sorted(mapping, key=lambda x: (x[2], x[1])):
        starts.append((slot, version, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + sizes.get(slot, 0)
    table = rows.sparkSession.createDataFrame(starts, "at int, version int, shard int, start bigint")
    kept = rows.drop("shard", "slot", "map_version")
    # the row travels as one column, so its names meet no others
    packed = kept.select("virtual_slot", F.struct(*kept.columns).alias("row"))
    w = Window.partitionBy("virtual_slot").orderBy(*[F.col("row")[c] for c, kind in kept.dtypes if c != "virtual_slot" and "map<" not in kind and kind != "variant"])
    numbered = packed.withColumn("number", F.row_number().over(w)).join(F.broadcast(table), F.col("virtual_slot") == F.col("at"))
    return numbered.select("row.*", "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.col("version").alias("map_version"))


def write_shards(docs: DataFrame, mapping: list[tuple], path: str, n_slots: int = SLOTS) -> None:
    """Writes docs as one folder a shard (shard=0, shard=1, ...), each in files of whole virtual slots, with virtual_slot
    and size. A column shard of docs is replaced, as the folders have that name. A map that lacks slots is refused."""
    _whole(mapping, n_slots)
    table = docs.sparkSession.createDataFrame([(x[1], x[2]) for x in mapping], "at int, shard int")
    rows = with_slots(docs.drop("shard"), n_slots)
    rows = rows.select("virtual_slot", F.struct(*rows.columns).alias("row")).repartition("virtual_slot")
    rows.join(F.broadcast(table), F.col("virtual_slot") == F.col("at")).select("row.*", "shard").write.partitionBy("shard").parquet(path)

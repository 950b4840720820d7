"""Best-fit packing by linear grouping.

Texts become token ids; only those longer than the capacity are cut, into full pieces and one shorter first piece.
The lengths' histogram (at most ``capacity`` rows) is all that the driver sees. On it

1. lengths above ``small`` are dealt, longest first, into groups of equal cardinality and rounded up to the longest
   of their group;
2. the few rounded sizes are packed by configurations (how many of each size fit one sequence): column generation
   for the cutting-stock linear program, rounded down, the handful left over by best fit;
3. actual pieces take the places: the n-th piece of a length has a place by arithmetic, because places are handed out
   as ranges of ranks;
4. small pieces, longest first, go where they leave the least room, also in whole ranges.

The plan has some thousand rows, whatever the number of documents. Ranking pieces and looking up their places are
Spark jobs on narrow rows; ranks are counted in salted blocks, so a length that a third of all pieces have is no
single task's work.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettercrate.llm.common import written

CAPACITY, SMALL, GROUPS = 1024, 448, 128
END = 2
#: Rows of one length are ranked in blocks of so many, or of one in so many of all rows where that is more.
RANKED_TOGETHER, MOST_BLOCKS = 1_000, 100_000
#: What a Python worker remembers of runs and their ids, in bytes, an entry's own overhead included.
MOST_REMEMBERED, ENTRY = 128 << 20, 200


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> ids as little-endian unsigned 32-bit numbers, the same as the tokenizers library gives, added tokens such
    as <|endoftext|> in a text included.

    A pre-token always ends before a space or line feed between two characters other than white space. Runs between
    such places are encoded apart, those of a batch together, and remembered for the life of a Python worker. Texts
    with other white space, or several in a row, are encoded whole.
    """
    import json

    import numpy as np
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, special = whole["model"], {x["content"]: x["id"] for x in whole.get("added_tokens", ())}
    # the byte alphabet of byte-level BPE: printable Latin-1 characters are themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    others = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
    wide = others + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    known: dict[str, bytes] = {}
    size = 0

    def encode(text: str):
        return coding.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def runs_of(text: str) -> list[str] | None:
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            return None
        if any(c in text for c in (others if text.isascii() else wide)):
            return None
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def ids_of(texts: list[str]) -> list[bytes]:
        nonlocal size
        if size > MOST_REMEMBERED:
            known.clear()
            size = 0
        known["\n"] = encode("\n").tobytes()
        runs = [runs_of(x) for x in texts]
        new = [r for r in set().union(*(r for r in runs if r)) if r not in known]
        if new:
            ids = encode("\n".join(new))
            ends = np.flatnonzero(ids == int.from_bytes(known["\n"], "little")).tolist()
            flat = ids.tobytes()
            for run, a, b in zip(new, [0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True):
                known[run] = flat[4 * a : 4 * b]
                size += ENTRY + len(run) + 4 * (b - a)
        of = known.__getitem__
        return [b"".join(map(of, r)) if r else encode(x).tobytes() if x else b"" for x, r in zip(texts, runs, strict=True)]

    return ids_of


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (binary: little-endian unsigned 32-bit) of every piece of every document.

    A null text counts as empty, an empty one as its end id alone. The path of the tokenizer must be valid on
    executors.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"

    def per_batch(batches):
        ids_of, last = _encoder(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), ids_of(texts), strict=True):
                    ids += last
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    out += [(doc, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(pairwise(cuts))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(per_batch, schema)


def _best_configuration(sizes, values, capacity):
    """The most valuable multiset of sizes within capacity (unbounded knapsack) as counts, and its value."""
    import numpy as np

    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        gain = np.where(fits, best[np.where(fits, c - sizes, 0)] + values, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], pick[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0 or (c and best[c] == best[c - 1]):
            c -= 1
            continue
        counts[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return counts, float(best[capacity])


def configurations(sizes: list[int], demand: list[int], capacity: int, most_rounds: int = 1500) -> list[tuple[list[int], int]]:
    """(counts of each size, times): configurations that together hold exactly the demand."""
    import numpy as np

    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(most_rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        column, value = _best_configuration(s, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step, times = np.linalg.solve(basis, column), np.linalg.solve(basis, d)
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.linalg.solve(basis, d) + 1e-9).clip(0).astype(int)
    out, left = [], np.array(demand)
    for j, t in enumerate(times):
        column = basis[:, j].astype(int)
        t = min([int(t), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if t:
            out.append((column.tolist(), t))
            left -= t * column
    bins: list[tuple[int, list[int]]] = []  # best fit, longest first, of what rounding down left: less than len(sizes) bins' worth
    for i in np.argsort(-s):
        for _ in range(int(left[i])):
            room = [(b[0], k) for k, b in enumerate(bins) if b[0] >= s[i]]
            if room:
                k = min(room)[1]
            else:
                k = len(bins)
                bins.append((capacity, [0] * len(s)))
            bins[k][1][i] += 1
            bins[k] = (bins[k][0] - int(s[i]), bins[k][1])
    return out + [(b[1], 1) for b in bins]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, sequence, offset): the pieces of a length with ranks from from_rank up to before
    to_rank stand at that offset of sequences sequence, sequence + 1, and so on."""
    rows, sequence = [], 0
    full = histogram.get(capacity, 0)
    if full:
        rows.append((capacity, 0, full, 0, 0))
        sequence = full
    large = sorted((x for x in histogram if small < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    runs: dict[int, list[list[int]]] = {}  # rounded size: runs of (length, first rank, count)
    seen = 0
    size = number = -1
    for x in large:
        rank = 0
        while rank < histogram[x]:
            group = seen * groups // total
            if group != number:
                number, size = group, max(x, 0)
            take = min(histogram[x] - rank, max(1, -(-(group + 1) * total // groups) - seen))
            runs.setdefault(size, []).append([x, rank, take])
            rank += take
            seen += take
    sizes = list(runs)
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of (first sequence, count)
    for counts, times in configurations(sizes, [sum(r[2] for r in runs[x]) for x in sizes], capacity):
        slots = []  # the runs of lengths that take each place, times pieces in all
        for x, n in zip(sizes, counts, strict=True):
            for _ in range(n):
                slot, need = [], times
                while need:
                    run = runs[x][0]
                    take = min(need, run[2])
                    slot.append((run[0], run[1], take))
                    need -= take
                    run[1] += take
                    run[2] -= take
                    if not run[2]:
                        runs[x].pop(0)
                slots.append(slot)
        at, places = 0, [0] * len(slots)
        while at < times:
            step = min(slot[k][2] for slot, k in zip(slots, places, strict=True))
            offset = 0
            for i, slot in enumerate(slots):
                x, rank, n = slot[places[i]]
                rows.append((x, rank, rank + step, sequence, offset))
                offset += x
                slot[places[i]] = (x, rank + step, n - step)
                if n == step:
                    places[i] += 1
            room.setdefault(capacity - offset, []).append((sequence, step))
            sequence += step
            at += step
    for x in sorted((x for x in histogram if x <= small and x < capacity), reverse=True):
        rank, n = 0, histogram[x]
        while rank < n:
            fit = min((r for r in room if r >= x), default=None)
            if fit is None:
                each = capacity // x
                fresh = -(-(n - rank) // each)
                room[capacity] = [(sequence, fresh)]
                sequence += fresh
                continue
            first, count = room[fit].pop()
            if not room[fit]:
                del room[fit]
            each = fit // x
            whole = min(count, (n - rank) // each)
            parts = [(first, whole, each)] if whole else []
            if whole < count and (n - rank) % each and not (n - rank) // each - whole:
                parts.append((first + whole, 1, (n - rank) % each))
            for start, many, per in parts:
                for j in range(per):
                    rows.append((x, rank, rank + many, start, capacity - fit + j * x))
                    rank += many
                room.setdefault(fit - per * x, []).append((start, many))
            used = sum(p[1] for p in parts)
            if used < count:
                room.setdefault(fit, []).append((first + used, count - used))
    return rows


def place(lengths: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """lengths (a written table with length, 1 to capacity, and any other columns) with sequence_id and offset.

    Rows are read more than once: lengths must come from files.
    """
    spark, order = lengths.sparkSession, lengths.columns
    counts = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return lengths.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    together = max(RANKED_TOGETHER, sum(counts.values()) // MOST_BLOCKS)
    salts = spark.createDataFrame([(int(x), -(-n // together)) for x, n in counts.items()], "length bigint, _salts bigint")
    rows = lengths.join(F.broadcast(salts), "length").withColumn("_order", F.xxhash64(*order))
    rows = rows.withColumn("_salt", F.pmod("_order", "_salts"))
    # where the block of a length and salt starts; one row a block
    blocks = rows.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_order", *[c for c in order if c != "length"])))
    rows = rows.join(blocks, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    table = spark.createDataFrame(plan(counts, capacity, small, groups), "length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    rows = rows.join(F.broadcast(table), "length").where("_from <= _rank and _rank < _to")
    return rows.select(*order, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document stands.

    docs has doc_id and text; other columns are ignored. Repeated rows are packed as often as they occur.
    """
    cut = pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(written(cut), capacity, small, groups)

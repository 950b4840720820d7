"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on whole sets, union-find by star joins.

A document's set is that of its distinct word shingles. In a SuperMinHash signature every element has a permutation of
the slots: it gets the rank j in one slot for each j, and offers that slot the value j + u with u in [0, 1). A slot
keeps the least value, so two sets agree in a slot with the probability of their Jaccard similarity, while ranks that
differ within an element make slots vary less together than independent hashes do. Ranks are dealt from 0 upwards, so a
signature is complete once all its slots are below the next rank; a set of n elements needs about m * ln(m) / n ranks.
Permutations are the affine maps of the field of SLOTS elements, drawn by the element's hash: any two slots go to any
two others equally often, so the variance, which depends on pairs of slots only, is that of permutations drawn from all.

Equal sets are one node. Bands of slots give each node its buckets. A node is compared with its buckets' least and
greatest nodes first, which is linear in the size of a group and joins most of it. Buckets that then still hold several
components are gone through in blocks: pairs in the same component, pairs that another bucket is in charge of and pairs
that differ too much by their sketches are dropped inside the join, so rows are made only for those left to verify. Of
the two sketches one keeps some bits of each slot. The other has the parity of the number of elements in each of
PARITIES classes of hashes: each element that only one of two sets has turns one bit, so the bits that differ never
outnumber those elements. It is sharp for sets that are small beside PARITIES, the former for large ones.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, written
from lettercrate.llm.simhash import components, looked_up

WIDTH = 4
PERCENT = 80
#: Slots of a signature: a prime; bands and sketches use all but the last.
SLOTS = 257
#: Bits of each slot that a sketch keeps.
SKETCH_BITS = 4
#: Bits of the other sketch.
PARITIES = 1024
#: Chance at most that banding, or the comparison of sketches, loses a pair right at the threshold.
MISS = 1e-8
#: Nodes of a crowded bucket that meet as many others at a time.
BLOCK = 1024
#: Most documents, and about as many shingles, whose signatures are worked out together.
DOCS_AT_ONCE, AT_ONCE = 1000, 200_000
GOLDEN = 0x9E3779B97F4A7C15


def band_rows(percent: int = PERCENT, miss: float = MISS) -> int:
    """Slots a band: the most with which a pair at the threshold shares no band with a chance of ``miss`` or less."""
    fits = [r for r in range(1, 33) if (1 - (percent / 100) ** r) ** ((SLOTS - 1) // r) <= miss]
    return max(fits, default=1)


def most_different(percent: int = PERCENT) -> int:
    """Slots of a sketch in which a pair at the threshold may differ: six and a half deviations above the mean."""
    n, p = SLOTS - 1, (1 - percent / 100) * (1 - 0.5**SKETCH_BITS)
    return math.ceil(n * p + 6.5 * math.sqrt(n * p * (1 - p)))


def _mix(z):
    """The finalizer of SplitMix64, on an array of unsigned 64-bit numbers."""
    import numpy as np

    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _nth(h, i: int):
    """The i-th random number of each element."""
    import numpy as np

    return _mix(h + np.uint64(GOLDEN * (i + 1) & (1 << 64) - 1))


def shingle_hashes(text: bytes | None, width: int):
    """Sorted distinct 64-bit hashes of the shingles of a text: runs of ``width`` words joined by spaces; with fewer words
    the whole sequence; without words none."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, and the white space of the contract
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(width, len(words)) - 1
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[last:].tolist(), strict=False)], np.uint64))


def signatures(sets: list):
    """A row of SLOTS values for each set (none of them empty): the rank in the upper, its fraction in the lower 32 bits."""
    import numpy as np

    m, rank = np.uint64(SLOTS), np.uint64(32)
    out = np.full((len(sets), SLOTS), m << rank)
    flat, h = out.reshape(-1), np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot, step = _nth(h, 0) % m, _nth(h, 1) % (m - np.uint64(1)) + np.uint64(1)
    for j in range(SLOTS):
        np.minimum.at(flat, owner * SLOTS + slot.astype(np.int64), (np.uint64(j) << rank) | (_nth(h, j + 2) >> rank))
        going = ((out.max(axis=1) >> rank) > np.uint64(j))[owner]  # a slot holds more than any value of the next rank
        if not going.any():
            break
        h, owner, slot, step = h[going], owner[going], ((slot + step) % m)[going], step[going]
    return out


def _keys(signature, rows: int):
    """A 64-bit key for each band of each signature; bands have keys of their own."""
    import numpy as np

    n = (SLOTS - 1) // rows
    key = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN))[None, :].repeat(len(signature), 0)
    for i in range(rows):
        key = _mix(key + _mix(signature[:, i : n * rows : rows]))
    return key.view(np.int64)


def _sketches(signature):
    """For each signature SKETCH_BITS planes of a bit a slot, as signed 64-bit numbers."""
    import numpy as np

    bits = _mix(signature[:, : SLOTS - 1])
    planes = [np.packbits(((bits >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little") for i in range(SKETCH_BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view("<i8")


def _parities(sets: list):
    """For each set a bit for each class of hashes: whether it has an odd number of them. As signed 64-bit numbers."""
    import numpy as np

    odd = [np.bincount((s & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1 for s in sets]
    return np.packbits(np.array(odd, np.uint8).reshape(len(sets), PARITIES), axis=1, bitorder="little").view("<i8")


def _rows_of(matrix) -> pa.Array:
    import numpy as np

    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(matrix.reshape(-1)))


def marks(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, at (a hash of id and text), n_shingles, and for documents with words digest (128 bits of the set), keys (of
    the bands), sketch and odd (the sketch of parities). A document without words has null for these."""
    rows = band_rows(percent)

    def per_batch(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            ids, at, texts = batch.columns
            texts = texts.cast(pa.binary())
            start = 0
            while start < len(texts):
                sets, total, stop = [], 0, start
                while stop < len(texts) and len(sets) < DOCS_AT_ONCE and total < AT_ONCE:
                    sets.append(shingle_hashes(texts[stop].as_py(), width))
                    total += len(sets[-1])
                    stop += 1
                some = [i for i, s in enumerate(sets) if len(s)]
                place = np.full(len(sets), -1)
                place[some] = range(len(some))
                order = pa.array(place, pa.int64(), mask=place < 0)
                with_words = [sets[i] for i in some]
                signature = signatures(with_words) if some else np.zeros((0, SLOTS), np.uint64)
                columns = [
                    ids[start:stop], at[start:stop], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    *[_rows_of(x).take(order) for x in (_keys(signature, rows), _sketches(signature), _parities(with_words))],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "n_shingles", "digest", "keys", "sketch", "odd"])
                start = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, at bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>, odd array<bigint>"
    return docs.select("doc_id", _at().alias("at"), "text").mapInArrow(per_batch, schema)


def _at() -> Column:
    return F.xxhash64("doc_id", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, hashes: the sets of the wanted nodes (node, at, digest), each worked out from one text."""

    def per_batch(batches):
        import xxhash

        for batch in batches:
            found = [(n, shingle_hashes(t, width), d) for n, t, d in zip(batch["node"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["digest"].to_pylist(), strict=True)]
            found = [(n, s) for n, s, d in found if xxhash.xxh3_128_digest(s.tobytes()) == d]
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([s.view("i8") for _, s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes"])

    texts = docs.select(_at().alias("at"), "text").join(wanted, "at").dropDuplicates(["at", "digest"])
    return texts.select("node", "text", "digest").mapInArrow(per_batch, "node bigint, hashes array<bigint>")


def _alike_sizes(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ more can't be as similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("in_a"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    return pairs.join(b, "b").join(a, "a").where((100 + percent) * both >= percent * (F.size("in_a") + F.size("in_b"))).select("a", "b")


def _rest(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket whose components still differ and that neither are a bucket's least or greatest node nor
    differ too much by their sizes and sketches. Each pair once, from the least key that both have."""
    rows = buckets.where("node != lo and node != hi").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("rows")).where("least != most")
    rows = rows.join(mixed.select("key", "rows"), "key")
    n_blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    planes = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH_BITS * (SLOTS - 1) // 64)]
    rows = rows.select("key", "node", "root", (n_blocks - 1).alias("last"), F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("own"))
    odd = [F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(PARITIES // 64)]
    rows = rows.join(nodes.select("node", "n_shingles", "keys", *planes, *odd), "node")

    def side(name: str, first: Column, last: Column) -> DataFrame:
        """One side of a grid of blocks: a's block comes before b's, or is the same."""
        keep = rows.select("key", "own", F.explode(F.sequence(first, last)).alias("other"), *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("key", "own", "last")])
        a, b = ("own", "other") if name == "a" else ("other", "own")
        return keep.select("key", F.col(a).alias("i"), F.col(b).alias("j"), *[c for c in keep.columns if c.startswith(f"{name}_")])

    a, b = side("a", F.col("own"), F.col("last")), side("b", F.lit(0), F.col("own"))
    words = (SLOTS - 1) // 64
    differ = F.lit(0)
    for w in range(words):
        plane = [F.col(f"a_s{w + words * i}").bitwiseXOR(F.col(f"b_s{w + words * i}")) for i in range(SKETCH_BITS)]
        any_bit = plane[0]
        for x in plane[1:]:
            any_bit = any_bit.bitwiseOR(x)
        differ = differ + F.bit_count(any_bit)
    kept = ((F.col("i") < F.col("j")) | (F.col("a_node") < F.col("b_node"))) & (F.col("a_root") != F.col("b_root")) & _alike_sizes("a_n_shingles", "b_n_shingles", percent)
    turned = sum((F.bit_count(F.col(f"a_o{i}").bitwiseXOR(F.col(f"b_o{i}"))) for i in range(PARITIES // 64)), F.lit(0))
    kept = kept & ((100 + percent) * turned <= (100 - percent) * (F.col("a_n_shingles") + F.col("b_n_shingles")))
    kept = kept & (differ <= most_different(percent)) & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key"))
    return a.join(b, ["key", "i", "j"]).where(kept).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(marks of all documents, a written table of digest, n (its documents) and component_id), the least doc_id that can
    be reached over links."""
    found = written(marks(docs, width, percent))
    own = found.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min("at").alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd")
    )
    nodes = written(own.withColumn("node", F.monotonically_increasing_id()))

    rows = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    one = F.struct("node", "n_shingles")
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("rows > 1").drop("rows")
    rows = rows.join(sizes, "key").select("key", "node", "n_shingles", F.col("lo.node").alias("lo"), F.col("lo.n_shingles").alias("lo_n"), F.col("hi.node").alias("hi"), F.col("hi.n_shingles").alias("hi_n"))
    buckets = written(rows)

    stars = buckets.where(_alike_sizes("n_shingles", "lo_n", percent)).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    stars = stars.unionByName(buckets.where(_alike_sizes("n_shingles", "hi_n", percent)).select(F.col("node").alias("a"), F.col("hi").alias("b")))
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "at", "digest")
    sets = written(sets_of(docs, wanted, width))
    links = written(verified(stars.where("a < b").distinct(), sets, percent))
    left = written(_rest(buckets, nodes, components(links), percent))
    roots = components(links.unionByName(verified(left, sets, percent)))
    rooted = written(nodes.select("digest", "node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("digest", "root", "n", "least"))
    whole = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = written(looked_up(rooted.select("digest", "root", F.col("n").alias("docs")), whole, "root").select("digest", "component_id", F.col("docs").alias("n")))
    for table in (nodes, buckets, sets, links, left, rooted, whole):
        discard(table)
    return found, named


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that can be reached over links, its
    own included) and kept (whether that is its own).

    docs has doc_id and text; other columns are ignored. Two documents are linked if 100 * intersection >= percent *
    union of their sets. A null text, or one without words, has an empty set and links with nothing. A null doc_id is the
    least of a component only where all are null, and is kept there. Repeated rows get equal rows; no rows give no rows.
    """
    found, named = groups(docs.select("doc_id", "text"), width, percent)
    with_words = looked_up(found.where("digest is not null").select("doc_id", "n_shingles", "digest"), named, "digest")
    without = found.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = with_words.select("doc_id", "n_shingles", "component_id").unionByName(without)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Document fingerprints from closed syncmers over tokens.

Tokens are words, and in scripts without spaces letters. A k-mer (k tokens in a row) is chosen when the least of its s-mers (by hash) is its first or its last one. Whether a
k-mer is chosen depends on its own words alone, so equal passages have equal anchors wherever they stand, and anchors
carry their place for positional matching. A text of fewer than k words has one anchor, its whole word sequence; a
text without words has none. A text of k words or more in which no k-mer is chosen has none either, unless ``always``
is set, as the query does: then its least k-mer (by hash, then place) stands in. Every step is a DataFrame expression on one row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lettercrate.llm.common import tokens_of

K, S = 7, 2


def anchors(df: DataFrame, text: str, into: str, k: int = K, s: int = S, always: bool = False) -> DataFrame:
    """df with the column ``into``: array<struct<place int, hash long>>, the chosen k-mers in order of place."""
    m = k - s + 1
    words, inner = f"_{into}_words", f"_{into}_inner"
    df = df.withColumn(words, tokens_of(F.col(text)))
    w = F.col(words)
    smers = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, s))))
    df = df.withColumn(inner, F.slice(smers, 1, F.greatest(F.size(w) - (s - 1), F.lit(0))))
    h = F.col(inner)

    def parts(x: Column, i: Column) -> tuple[list[Column], Column]:
        rest = [F.get(h, i + j) for j in range(1, m)]
        spread = [x, *(rest[j - 1] for j in range(s, m - 1, s)), rest[-1]]  # s-mers that cover all words of the k-mer
        return rest, F.xxhash64(*spread).alias("hash")

    def chosen(x: Column, i: Column) -> Column:
        rest, number = parts(x, i)
        return F.when(F.least(x, *rest).isin(x, rest[-1]), F.struct(i.alias("place"), number))

    def every(x: Column, i: Column) -> Column:
        return F.struct(parts(x, i)[1], i.alias("place"))

    kmers = F.filter(F.slice(F.transform(h, chosen), 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(F.array_join(w, " ")).alias("hash")))
    few = F.when(F.size(w) == 0, F.slice(whole, 1, 0)).otherwise(whole)
    df = df.withColumn(into, F.when(F.size(w) < k, few).otherwise(kmers))
    if not always:
        return df.drop(words, inner)
    least = F.array_min(F.slice(F.transform(h, every), 1, F.greatest(F.size(w) - (k - 1), F.lit(0))))
    least = F.array(F.struct(least["place"].alias("place"), least["hash"].alias("hash")))
    return df.withColumn(into, F.when((F.size(into) == 0) & (F.size(w) >= k), least).otherwise(F.col(into))).drop(words, inner)


def fingerprint(found: Column) -> Column:
    """The sorted set of anchor hashes."""
    return F.sort_array(F.array_distinct(found["hash"]))


def as_text(hashes: Column) -> Column:
    """A fingerprint as text: 16 hex digits a hash, space-joined."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def aligned(a: Column, b: Column) -> Column:
    """How many anchors two documents have in common at one and the same place."""
    placed = lambda x: F.transform(x, lambda y: F.xxhash64(y["place"], y["hash"]))
    return F.size(F.array_intersect(placed(a), placed(b))).cast("long")


def matches(left: DataFrame, right: DataFrame, min_anchors: int = 2) -> DataFrame:
    """Positional matching of a stated query set on the left: pairs (left_id, right_id, shift, n_anchors) of documents
    with at least min_anchors common anchors at one shift (place on the right minus place on the left).

    Both frames have doc_id and anchors. Repeated anchors are counted once for each pair of places. For all documents
    against all use first_matches, whose rows grow with the anchors and not with their pairs.
    """
    a = left.select(F.col("doc_id").alias("left_id"), F.explode("anchors").alias("x")).select("left_id", F.col("x.place").alias("p"), F.col("x.hash").alias("hash"))
    b = right.select(F.col("doc_id").alias("right_id"), F.explode("anchors").alias("x")).select("right_id", F.col("x.place").alias("q"), F.col("x.hash").alias("hash"))
    pairs = a.join(b, "hash").groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n_anchors"))
    return pairs.where(F.col("n_anchors") >= min_anchors)


def first_matches(docs: DataFrame, min_anchors: int = 2) -> DataFrame:
    """Positional matching of all documents: rows (doc_id, first_id, shift, n_anchors), where first_id is the least
    document with an anchor of doc_id and shift the place there minus the place here, with at least min_anchors such
    anchors. docs has doc_id and anchors; rows without an id are left out.

    An anchor is paired with its first place alone, so one that a third of all documents share costs a row for each
    document; the first places are an aggregate, combined before the shuffle.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.*")
    firsts = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(firsts, "hash").where(F.col("doc_id") != F.col("first.doc_id"))
    pairs = pairs.groupBy("doc_id", F.col("first.doc_id").alias("first_id"), (F.col("first.place") - F.col("place")).alias("shift")).agg(F.count("*").alias("n_anchors"))
    return pairs.where(F.col("n_anchors") >= min_anchors)


def _cuts(docs: DataFrame, parts: int) -> list[list[int]]:
    """Ids that cut the documents with ids into about ``parts`` runs of equal counts, in two levels: the last id of every
    upper run closes its list. One id for each range, so the lists grow with the table (one for 2,000 rows)."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"))
    upper = min(1000, parts)
    quantiles = lambda n: [i / n for i in range(1, n + 1)]
    tops = sorted(set(ids.agg(F.percentile_approx("id", quantiles(upper), 20 * upper)).first()[0] or ()))
    lower = -(-parts // upper)
    if lower == 1:
        return [[x] for x in tops]
    run = F.size(F.filter(F.lit(tops), lambda c: c < F.col("id")))
    found = ids.groupBy(run.alias("run")).agg(F.percentile_approx("id", quantiles(lower), 20 * lower).alias("cuts"))
    return [sorted(set(r["cuts"])) for r in found.orderBy("run").collect()]


def in_ranges(docs: DataFrame, rows_per_range: int = 2000) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of doc_id for windows that look at the next document.

    Order: descending doc_id, equal ids by the hash of their text, null ids last by the hash of their text, and after the
    last the first again. Ids are cut at quantiles, rows without an id at equal steps of the hash, so ranges have about
    equal row counts and their number grows with the table. Each range also gets the rows that come after its own last
    row (``_own`` false), so a ``lead`` over in_order() finds every next row without a global sort.
    """
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"))
    stats = rows.agg(F.count("doc_id").alias("n"), F.max("doc_id").cast("bigint").alias("top"), F.count_if(F.isnull("doc_id")).alias("bare")).first()
    lists = _cuts(docs, max(1, stats["n"] // rows_per_range)) if stats["n"] else []
    tops, starts = [x[-1] for x in lists], [0]
    for x in lists:
        starts.append(starts[-1] + len(x))
    this = F.col("doc_id").cast("bigint")
    longs = lambda x: F.lit(x).cast("array<bigint>")
    nested = F.array(*[longs(x) for x in lists]) if lists else F.lit(None).cast("array<array<bigint>>")
    above = F.size(F.filter(longs(tops), lambda c: c < this))
    mine = F.get(nested, above)
    # range i holds the ids above the cut before it up to its own; 0 is the last of those with ids
    number = F.get(longs(starts), above) + F.size(F.filter(mine, lambda c: c < this))
    is_cut = F.array_contains(mine, this) & (this != stats["top"]) if lists else F.lit(False)

    # rows without an id: ranges -1, -2, ... in order; each range's first hash is known
    steps = max(1, stats["bare"] // rows_per_range)
    step = F.floor((F.shiftright("_tie", 32) + (1 << 31)) * steps / (1 << 32)).cast("long")
    heads = sorted(tuple(r) for r in rows.where("doc_id is null").groupBy(step.alias("s")).agg(F.min("_tie")).collect()) if stats["bare"] else []
    last = -1 - heads[-1][0] if heads else 0
    bare_range = -1 - step
    before = [0 if lists else None, *(-1 - s for s, _ in heads)]  # the range before each head, none before the very first row
    places_of_heads = F.create_map(*[x for (_, tie), at in zip(heads, before, strict=False) if at is not None for x in (F.lit(tie), F.lit(at).cast("long"))]) if len(heads) + bool(lists) > 1 else None
    first = this == F.lit(stats["top"]) if lists else F.isnull(this) & (F.col("_tie") == F.lit(heads[0][1] if heads else 0))

    def place(at: Column, is_own: bool, late: int) -> Column:
        return F.struct(at.cast("long").alias("_range"), F.lit(is_own).alias("_own"), F.lit(late).alias("_late"))

    head_at = F.try_element_at(places_of_heads, F.col("_tie")) if places_of_heads is not None else F.lit(None).cast("long")
    places = F.array_compact(F.array(
        place(F.when(this.isNull(), bare_range).otherwise(number), True, 0),
        F.when(is_cut, place(number + 1, False, 1)),
        F.when(this.isNull() & head_at.isNotNull(), place(head_at, False, 1)),
        F.when(first, place(F.lit(last), False, 2)),
    ))
    return rows.select("doc_id", "text", "_tie", F.explode(places).alias("_place")).select("doc_id", "text", "_tie", "_place.*")


def in_order() -> WindowSpec:
    """The window over in_ranges in which a row's next document follows it."""
    return Window.partitionBy("_range").orderBy("_late", F.desc_nulls_last("doc_id"), "_tie")


def edited(text: Column, following: Column) -> Column:
    """text with its last third (rounded down) replaced by as many code points from the head of the following text."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compare_with_edits(docs: DataFrame, k: int = K, s: int = S, always: bool = False) -> DataFrame:
    """A row for each row of docs: its fingerprint, that of its edited text, and its likeness to that and to the next
    document's; n_anchors, and n_aligned, the anchors of the edited text that stand where the text has them.

    docs has doc_id (an integer) and text; other columns are ignored. A null text counts as empty; a table of one row
    has itself as the next document; no rows give no rows.

    The text is shuffled once; both windows use that one exchange and sort.
    """
    w = in_order()
    rows = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit("")))
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("_next"))).drop("_next")
    rows = anchors(anchors(rows, "text", "_a", k, s, always), "_edited", "_b", k, s, always)
    rows = rows.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("_edited", 256), "n_aligned": aligned(F.col("_a"), F.col("_b"))})
    rows = rows.withColumns({"_a": fingerprint(F.col("_a")), "_b": fingerprint(F.col("_b"))}).drop("text", "_edited")
    rows = rows.withColumn("_c", F.lead("_a").over(w)).where("_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("_a")).alias("fingerprint"), as_text(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"),
        F.size("_a").cast("long").alias("n_anchors"), "n_aligned",
    )

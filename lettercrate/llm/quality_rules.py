"""Quality rules: document counts, and a hashed n-gram likelihood ratio of trusted text to raw text.

Words and pairs of neighbouring words are hashed into buckets, whose numbers grow in proportion to the corpus without a
bound, one for at most ``load`` n-grams of it. Two multinomials over the buckets are counted on all documents: one on
the trusted documents, one on the raw corpus. A document's score is the mean, over its n-grams, of
log(p_trusted / p_raw); documents whose score is below ``threshold`` are rejected.

Everything is DataFrame expressions. The two counts are one aggregation over exploded n-grams (combined before the
shuffle, so a frequent word costs one row a task). The ratios of up to MOST_BROADCAST buckets (32 MB) become one array,
in which a document's n-grams are looked up without exploding or shuffling them; a larger table meets the n-grams in a
merge join. Ratios are whole numbers of millionths, so sums don't depend on the order of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, words_of, written

#: Most n-grams of the corpus for each bucket; least bits of a word's and a pair's bucket.
LOAD = 128.0
LEAST_BITS = (16, 18)
#: Every task of the count shuffles a row for each bucket that it has met, so small tasks are put together, without a
#: shuffle, up to about so many words each (some 100 MB of text, and as many buckets as a task's share of memory holds),
#: while every core still has one.
WORDS_PER_TASK = 1 << 24
#: Most buckets of a table that is one array (4 bytes each), and how many of them are gathered in one row on the way there.
MOST_BROADCAST = 1 << 23
CHUNK = 1 << 12
#: Most ids of trusted documents that are broadcast (8 bytes each).
MOST_IDS = 1 << 20
#: In nats an n-gram: junk scores far below this, clean text that merely differs from the trusted documents above it.
THRESHOLD = -0.33
SMOOTHING = 5.0
MICRO = 1_000_000


def _marks(hashes: Column, word_bits: int) -> Column:
    """16 bits of each word's hash, or 32 or all 64 where the buckets need them: array<smallint>, array<int> or
    array<bigint>, of which the first two are less than the words themselves when shuffled."""
    shift, kind = (48, "smallint") if word_bits <= 16 else (32, "int") if word_bits <= 32 else (0, "bigint")
    return F.transform(hashes, lambda h: F.shiftright(h, shift).cast(kind))


def _one(x: Column, bits: tuple[int, int]) -> Column:
    """The bucket of a word, from its mark: the first 1 << bits[0]."""
    return x.cast("long").bitwiseAND(F.lit((1 << bits[0]) - 1).cast("long"))


def _two(x: Column, after: Column, bits: tuple[int, int]) -> Column:
    """The bucket of a pair of neighbouring words: 1 << bits[1] after those of words."""
    return F.xxhash64(x, after).bitwiseAND(F.lit((1 << bits[1]) - 1).cast("long")) + F.lit(1 << bits[0]).cast("long")


def _grams(marks: Column, bits: tuple[int, int]) -> Column:
    """Buckets of the words and of the pairs."""
    one = F.transform(marks, lambda x: _one(x, bits))
    two = F.transform(marks, lambda x, i: _two(x, F.get(marks, i + 1), bits))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(marks) - 1, F.lit(0))))


def _marks_of(text: Column, word_bits: int) -> Column:
    return _marks(F.transform(words_of(text), lambda w: F.xxhash64(w)), word_bits)


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """How many words and pairs of neighbouring words all documents have together."""
    words = F.size(words_of(F.col("text"))).cast("long")
    n = docs.agg(F.sum(words), F.sum(F.greatest(words - 1, F.lit(0).cast("long")))).first()
    return n[0] or 0, n[1] or 0


def bits_for(docs: DataFrame, load: float = LOAD, most_bits: int | None = None) -> tuple[int, int]:
    """Bits of the word and pair buckets: one bucket for at most ``load`` words, or pairs, of all documents together; fewer
    where a caller sets ``most_bits``, which nothing here does.

    The vocabulary grows more slowly than the corpus, so a bucket never stands for more distinct n-grams as the corpus
    grows.
    """
    return _bits(_sizes(docs), load, most_bits)


def _bits(sizes: tuple[int, int], load: float, most_bits: int | None) -> tuple[int, int]:
    needed = [max(0, int(n / load) - 1).bit_length() for n in sizes]
    bits = max(LEAST_BITS[0], needed[0]), max(LEAST_BITS[1], needed[1])
    return bits if most_bits is None else (min(most_bits, bits[0]), min(most_bits, bits[1]))


def with_counts(df: DataFrame, text: str = "text", word_bits: int = LEAST_BITS[0]) -> DataFrame:
    """df and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _marks for the n-grams.

    Repeated windows are found inside the row: the hash of each 3-word window, shifted to make room for its place, is
    sorted as a long; neighbours that agree in what is left of the hash may be repeats, and their whole 64-bit hashes
    decide, at any length of text. No rows are exploded.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = df.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_bits": F.length(F.bin(F.size("_words"))),
    }).drop("_words", "_lines")

    h, bits = F.col("_hashes"), F.col("_bits")
    packed = F.transform(
        h,
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("_packed", F.sort_array(F.slice(packed, 1, F.greatest(F.size(h) - 2, F.lit(0)))))

    s = F.col("_packed")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", x, bits) == F.call_function("shiftright", other, bits), F.lit(False))

    alike = F.filter(s, lambda x, i: F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(F.lit(False)) | same(x, F.get(s, i + 1)))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def whole(x: Column) -> Column:
        place = x.bitwiseAND(ones).cast("int")
        return F.struct(F.xxhash64(F.get(h, place), F.get(h, place + 1), F.get(h, place + 2)).alias("hash"), place.cast("long").alias("place"))

    df = df.withColumn("_alike", F.sort_array(F.transform(alike, whole)))
    c = F.col("_alike")
    equal = lambda x, other: F.coalesce(x["hash"] == other["hash"], F.lit(False))
    found = F.filter(c, lambda x, i: F.when(i > 0, equal(x, F.get(c, i - 1))).otherwise(F.lit(False)) | equal(x, F.get(c, i + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["place"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return df.withColumns({"n_repeat_words": covered, "_marks": _marks(F.col("_hashes"), word_bits)}).drop("_hashes", "_packed", "_bits", "_alike", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios(docs: DataFrame, trusted: DataFrame, bits: tuple[int, int], smoothing: float = SMOOTHING, tasks: int | None = None) -> DataFrame:
    """bucket, ratio (millionths of a nat): one row for each bucket that occurs in the corpus.

    Both multinomials get ``smoothing`` pseudo-counts a bucket, as many as are usual for their size, so an n-gram that
    is rare in the whole corpus says little about a document.

    trusted: doc_id of the trusted documents; repeated and null ids count once and never. Without any trusted
    document every ratio is 0. The texts are read by at most ``tasks`` tasks, if given.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    rows = docs.select("doc_id", "text")
    rows = (rows.coalesce(tasks) if tasks else rows).select("doc_id", _marks_of(F.col("text"), bits[0]).alias("_marks"))
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    if few:
        rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left")
    else:
        # more ids than may be broadcast: the marks, not the texts, are shuffled to them; rows without an id, which match none, are spread
        spread = F.when(F.isnull("doc_id"), F.xxhash64("_marks")).otherwise(F.lit(0).cast("long"))
        rows, ids = rows.withColumn("_spread", spread), ids.withColumn("_none", F.lit(0).cast("long"))
        rows = rows.join(ids.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_none")), "left")
    grams = rows.select("_trusted", F.explode(_grams(F.col("_marks"), bits)).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good")))
    n_raw, n_good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    ratio = F.lit(0)
    if n_good:
        # (good + s * n_good / n_raw) / (n_good + ...) over (raw + s) / (n_raw + ...): what is left of the two multinomials
        ratio = F.log((F.col("good") * n_raw / n_good + smoothing) / (F.col("raw") + smoothing))
    out = counts.select("bucket", F.round(ratio * MICRO).cast("long").alias("ratio"))
    out.written_at = counts.written_at
    return out


def _as_array(table: DataFrame, n_buckets: int) -> DataFrame:
    """One row, ratios: array<int> with the ratio of every bucket in its place, 0 for those without one."""
    every = table.sparkSession.range(n_buckets).select(F.col("id").alias("bucket"))
    every = every.join(table, "bucket", "left").select("bucket", F.coalesce("ratio", F.lit(0)).cast("int").alias("ratio"))
    parts = every.groupBy(F.floor(F.col("bucket") / CHUNK).alias("part")).agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("x"))
    parts = parts.select("part", F.col("x.ratio").alias("x"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("x")).select(F.flatten(F.col("x.x")).alias("ratios"))


def _variable(one: DataFrame) -> tuple[str, Column]:
    """The single value of a frame of one row, as a session variable (its name, and a column that reads it): lambdas can
    read those, but no subqueries. A column that is part of a frame keeps the value when the variable is dropped."""
    name = f"ratios_{uuid.uuid4().hex}"
    one.sparkSession.sql(f"DECLARE VARIABLE {name} {one.schema[0].dataType.simpleString()}")
    one.sparkSession.sql(f"SET VARIABLE {name} = (SELECT * FROM {{one}})", one=one)
    return name, F.expr(f"session.{name}")


def judge(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, load: float = LOAD, carried: tuple[str, ...] = (), most_broadcast: int = MOST_BROADCAST, most_bits: int | None = None
) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, kept, n_grams, score, and the carried columns.

    docs has doc_id and text; other columns are ignored unless carried (those must not have the name of a new column).
    A null text counts as empty. Documents with no words have score null and fail the base rules. Repeated rows get a
    row each; a null doc_id is kept as it is. An empty table gives an empty one.
    """
    sizes = _sizes(docs)
    bits = _bits(sizes, load, most_bits)
    table = ratios(docs, trusted, bits, tasks=max(docs.sparkSession.sparkContext.defaultParallelism, -(-sizes[0] // WORDS_PER_TASK)))
    n_buckets = (1 << bits[0]) + (1 << bits[1])
    keys = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *carried]
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0).cast("long")).alias("n_grams")
    if n_buckets <= most_broadcast:
        rows = with_counts(docs.select("doc_id", "text", *carried), word_bits=bits[0])
        name, ratio = _variable(_as_array(table, n_buckets))
        discard(table)
        marks, of = F.col("_marks"), lambda g: F.get(ratio, g.cast("int")).cast("long")

        def both(x: Column, i: Column) -> Column:
            after = F.get(marks, i + 1)
            return of(_one(x, bits)) + F.when(after.isNull(), F.lit(0).cast("long")).otherwise(of(_two(x, after, bits)))

        total = F.aggregate(F.transform(marks, both), F.lit(0).cast("long"), lambda a, x: a + x)
        # a filter on the verdict isn't pushed below this column, where it would have the counts worked out twice
        one = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
        scored = rows.select(*keys, n_grams, (total + one).alias("_sum"))
        docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE {name}")
    else:
        # rows with equal ids and texts add up to equal means
        key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key")
        grams = docs.select(key, _marks_of(F.col("text"), bits[0]).alias("_marks"))
        grams = grams.select("_key", F.explode_outer(_grams(F.col("_marks"), bits)).alias("bucket"))
        means = grams.join(table.hint("merge"), "bucket").groupBy("_key").agg(F.sum("ratio").alias("_total"), F.count("*").alias("_n"))
        rows = with_counts(docs.select("doc_id", "text", *carried, key))
        # a row's number, times nothing, keeps filters on the verdict above the counts, where they would be worked out for each word
        rows = rows.select((F.col("_key") + F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))).alias("_key"), *keys)
        scored = rows.join(means.hint("merge"), "_key", "left").select(*keys, n_grams, "_total", "_n")
        scored = scored.select(*keys, "n_grams", (F.col("_total") / F.col("_n") * F.col("n_grams")).alias("_sum"))
    score = F.when(F.col("n_grams") > 0, F.col("_sum") / F.col("n_grams") / MICRO)
    verdict = ~base_failed() & F.coalesce(F.col("_sum") >= F.lit(threshold * MICRO) * F.col("n_grams"), F.lit(False))
    return scored.select(*keys[:6], base_failed().alias("base_failed"), verdict.alias("kept"), "n_grams", score.alias("score"), *carried)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, load: float = LOAD) -> DataFrame:
    """The rows of docs, with all their columns (whatever their names), whose document is kept. Rows aren't shuffled for it."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return judge(rows, trusted, threshold, load, ("_row",)).where("kept").select("_row.*")

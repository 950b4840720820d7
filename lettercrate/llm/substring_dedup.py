"""Substring dedup over sliding sentence spans.

A text is cut into units. A unit is a sentence: it ends with a line, or after closing punctuation before white space. A
sentence of over ``longest`` words is no unit itself, since a passage copied from its middle would hold no whole one: it
is cut after every word whose hash is a multiple of CUT, so at the same words on both sides of an edit, and after
``longest`` words without such a word. From each unit on, the
shortest run of consecutive units with at least ``least_units`` units and ``least_words`` words is a span (with
``pair_words``, which the query sets, also one of two units with at least so many words), and so is
the shortest one backwards from each unit, where no forward one is the same; a text too short for any is one span as a
whole, if it has at least ``least_whole`` units (the query asks for two, so that a single sentence is never a run). Any longer run that repeats is covered by spans inside it: each of its units starts or ends one, or lies within
one. Spans are hashed (96 bits: the least 64 and the next 32 of a 128-bit hash, since at 10^13 spans 64 bits alone would
take about a million pairs of different runs for equal) and joined over all documents; the units of every occurrence but the first (least doc_id, then least place) are removed. Texts are
read in linear time, whatever they hold.

Only hashes and places are shuffled for the search, four numbers a span. The first place of a hash is an aggregate,
combined before the shuffle, so a passage that a third of all documents share costs a row a task there; in the join
back Spark splits such a hash, as neither side is needed together.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettercrate.llm.common import written

LEAST_UNITS, LEAST_WORDS, LONGEST, CUT = 3, 12, 20, 8
#: With so many words a run of two units is a span as well.
PAIR_WORDS = 24


#: Where a sentence ends: closing punctuation, quotes and brackets after it, white space; or a line feed. Runs are taken
#: from their start and whole, so no character is looked at again and again.
SENTENCE_END = re.compile(r"(?:(?<![.!?…])[.!?…]++[\"'”’)\]]*+(?=\s)|\n)\s*+")
WORD = re.compile(r"\S+")


def _units(body: str, longest: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each unit, in order; white space after a unit belongs to it, as does what stands before
    the first."""
    out, start = [], 0
    for stop in (*(m.end() for m in SENTENCE_END.finditer(body)), len(body)):
        words = WORD.findall(body, start, stop)
        if not words:
            continue
        if len(words) <= longest:
            out.append((start, stop, words))
        else:
            first, at = 0, start
            places = [m.start() for m in WORD.finditer(body, start, stop)]
            for i, w in enumerate(words[:-1], 1):
                if i - first >= longest or zlib.crc32(w.encode("utf-8", "surrogatepass")) % CUT == 0:
                    out.append((at, places[i], words[first:i]))
                    first, at = i, places[i]
            out.append((at, stop, words[first:]))
        start = stop
    return out


def _spans(counts: list[int], least_units: int, least_words: int, pair_words: int | None = None, least_whole: int = 1) -> dict[int, tuple[int, int]]:
    """{code: (first unit, end)} of the spans of a text whose units have these word counts. Codes: 0 for a whole text,
    twice the first unit and 2 more for those forwards from a unit, twice the end and 1 more for the others backwards."""

    def wide(units: int, words: int) -> bool:
        return (units >= least_units and words >= least_words) or (pair_words is not None and units >= 2 and words >= pair_words)

    n, out, total, end = len(counts), {}, 0, 0
    for first in range(n):
        while end < n and not wide(end - first, total):
            total += counts[end]
            end += 1
        if not wide(end - first, total):
            break
        out[2 * first + 2] = (first, end)
        total -= counts[first]
    if not out:
        return {0: (0, n)} if n >= max(1, least_whole) else {}
    total, first = 0, 0
    for end in range(1, n + 1):
        total += counts[end - 1]
        while wide(end - first - 1, total - counts[first]):
            total -= counts[first]
            first += 1
        if wide(end - first, total) and out.get(2 * first + 2) != (first, end):
            out[2 * end + 1] = (first, end)
    return out


def _mark(text: Column) -> Column:
    """32 bits that tell apart the texts of rows with one doc_id."""
    return F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32)


def spans(docs: DataFrame, least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS, longest: int = LONGEST, pair_words: int | None = None, least_whole: int = 1) -> DataFrame:
    """doc_id, at, hash, check: the spans of every document. at: the text's mark in the upper half, the span's code in the
    lower one; check: 32 bits of the hash beyond the 64 in hash. A doc_id that is no integer is null here."""
    schema = "doc_id bigint, at bigint, hash bigint, check int"

    def per_batch(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            ids, places, hashes, checks = [], [], [], []
            for doc, mark, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                units = [(" ".join(words), len(words)) for _, _, words in _units(body or "", longest)]
                found = _spans([n for _, n in units], least_units, least_words, pair_words, least_whole)
                for first, end in found.values():
                    long = xxhash.xxh3_128_intdigest(" ".join([u for u, _ in units[first:end]]).encode("utf-8", "surrogatepass"))
                    hashes.append(long & 0xFFFFFFFFFFFFFFFF)
                    checks.append(long >> 64 & 0xFFFFFFFF)
                ids += [doc] * len(found)
                places += [(mark << 32) + code for code in found]
            hashed = pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(np.array(checks, dtype=np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), *hashed], names=["doc_id", "at", "hash", "check"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _mark(F.col("text")), "text").mapInArrow(per_batch, schema)


def repeated(docs: DataFrame, least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS, longest: int = LONGEST, pair_words: int | None = None, least_whole: int = 1) -> DataFrame:
    """doc_id, mark, codes: for documents with spans seen before the sorted codes of these."""
    found = written(spans(docs, least_units, least_words, longest, pair_words, least_whole))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "at")
    firsts = found.groupBy("hash", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = found.join(written(firsts.select("hash", "check", "first")), ["hash", "check"]).where(place > F.col("first"))
    again = again.groupBy("doc_id", F.shiftright("at", 32).alias("mark"))
    return again.agg(F.sort_array(F.collect_list(F.col("at").bitwiseAND(0xFFFFFFFF))).alias("codes"))


def remove_repeats(docs: DataFrame, least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS, longest: int = LONGEST, pair_words: int | None = None, least_whole: int = 1) -> DataFrame:
    """A row for each row of docs: doc_id, removed_units (array<int>, their numbers from 0), removed_chars, text without
    them.

    docs has doc_id and text; other columns are ignored. A null text stays null, and it, an empty one and one of white
    space alone have no units. Rows with the same doc_id and text count as one document: they are treated alike, and
    don't make each other's spans repeated. A null doc_id comes after all others. No rows give no rows.
    """
    cut = repeated(docs, least_units, least_words, longest, pair_words, least_whole).select(F.col("doc_id").alias("_id"), "mark", "codes")
    rows = docs.select("doc_id", "text", _mark(F.col("text")).alias("_mark"))
    rows = rows.join(cut, rows["doc_id"].eqNullSafe(cut["_id"]) & (rows["_mark"] == cut["mark"]), "left").select("doc_id", "text", "codes")
    schema = "doc_id bigint, removed_units array<int>, removed_chars int, text string"

    def per_batch(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            numbers, chars, changed = [[]] * batch.num_rows, [0] * batch.num_rows, texts.to_pylist() if batch.column(2).null_count < batch.num_rows else None
            # texts without repeats go through as they are
            for row, codes in enumerate(batch.column(2).to_pylist()):
                if codes:
                    body = changed[row]
                    units = _units(body, longest)
                    found = _spans([len(w) for _, _, w in units], least_units, least_words, pair_words, least_whole)
                    drop = {k for code in codes for k in range(*found[code])}
                    changed[row] = "".join([body[a:b] for i, (a, b, _) in enumerate(units) if i not in drop])
                    numbers[row], chars[row] = sorted(drop), len(body) - len(changed[row])
            left = texts if changed is None else pa.array(changed, pa.string())
            columns = [ids, pa.array(numbers, pa.list_(pa.int32())), pa.array(chars, pa.int32()), left]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "removed_units", "removed_chars", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), "text", "codes").mapInArrow(per_batch, schema)

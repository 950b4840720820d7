"""Ranked lexical search by grouping documents on presence masks.

Items are taken in blocks of a bounded size. One pass over the documents keeps, of each, its length and how often the
terms of the block occur in it; from these come the statistics over all documents. Then every task takes its documents in
batches. For an item, bit i of a document's mask says whether it has the item's i-th term; documents with equal masks are
one group, which can score no more than the sum of its terms' best contributions in the batch. Groups are scored from the
highest such bound down, until the bound falls below the k-th best score that the task has seen in any batch: what is
left then can't be among the best, so the end is safe. The tasks' best are merged, in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, written

#: Documents returned for an item.
BEST = 10
#: Items, and terms of all items together, that are searched for at once; a longer item is a block of its own.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1000, 200_000
#: Documents of a batch whose masks are built together.
BATCH = 4096
#: Documents that are scored at least before the bound is looked at again.
STEP = 64
#: Everything but digits, letters and what lies beyond ASCII separates terms.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return ((text.encode() if isinstance(text, str) else text) or b"").translate(_BREAKS).split()


def blocks(items: DataFrame, most_items: int = ITEMS_AT_ONCE, most_terms: int = TERMS_AT_ONCE) -> Iterator[list[tuple]]:
    """Lists of (item_id, distinct terms), of a bounded size each; items are fetched partition by partition."""
    block, n = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of(text)))
        if block and (len(block) >= most_items or n + len(terms) > most_terms):
            yield block
            block, n = [], 0
        block.append((item_id, terms))
        n += len(terms)
    if block:
        yield block


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs: places in the vocabulary of those that a document has, and how often
    each occurs. Documents without any term are left out."""

    def per_batch(batches):
        from collections import Counter

        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms_of(text.as_py())
                if not found:
                    continue
                known = {place[t]: n for t, n in Counter(found).items() if t in place}
                ids.append(i)
                lengths.append(len(found))
                terms.append(list(known))
                tfs.append(list(known.values()))
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def _scores(tf, n, weight, n_docs: int, n_terms: int):
    """The contribution of each occurrence: all in whole numbers."""
    import numpy as np

    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * n_docs // n_terms
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _groups(bits):
    """(distinct masks as rows of bits, the documents of each) for a matrix of a row a term and a column a document."""
    import numpy as np

    packed = np.packbits(bits, axis=0, bitorder="little")
    packed = np.ascontiguousarray(np.pad(packed, ((0, -len(packed) % 8), (0, 0))).T)
    wide = packed.view(np.uint64 if packed.shape[1] == 8 else np.dtype((np.void, packed.shape[1]))).reshape(-1)
    some = np.flatnonzero(packed.any(axis=1))
    if not len(some):
        return bits[:, :0].T, []
    _, first, group = np.unique(wide[some], return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(1, len(first)))
    return bits[:, some[first]].T, np.split(some[order], cuts)


def _rank_key(score: int, doc_id) -> tuple:
    """Greater is better: the score, then the smaller id; a document without an id comes last."""
    return (score, doc_id is not None, -doc_id if doc_id is not None else 0)


def best_of_tasks(postings: DataFrame, items: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int = BEST) -> DataFrame:
    """item_no, doc_id, score: for each item (a list of places in the vocabulary) the k best documents of each task."""

    def per_task(batches):
        import heapq

        import numpy as np

        weight, wanted = np.array(weights, np.int64), [np.array(x, np.int64) for x in items]
        best: list[list[tuple]] = [[] for _ in items]
        is_term = np.zeros(len(weights), bool)

        def search(ids: list, n, terms, tfs, starts) -> None:
            size = np.diff(starts)
            doc = np.repeat(np.arange(len(ids)), size)
            score = _scores(tfs, n[doc], weight[terms], n_docs, n_terms)
            order = np.argsort(terms, kind="stable")
            by_term, its_doc = terms[order], doc[order]
            there, first = np.unique(by_term, return_index=True)
            most, ends = np.maximum.reduceat(score[order], first), np.append(first[1:], len(by_term))
            for number, own in enumerate(wanted):
                at = np.searchsorted(there, own)
                at = at[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == own)]
                if not len(at):
                    continue
                bits = np.zeros((len(at), len(ids)), np.uint8)
                for row, x in enumerate(at):
                    bits[row, its_doc[first[x] : ends[x]]] = 1
                masks, members = _groups(bits)
                bounds = masks.astype(np.int64) @ most[at]
                found, falling, done = best[number], np.argsort(-bounds, kind="stable"), 0
                is_term[own] = True
                while done < len(falling):
                    take = []
                    while done < len(falling) and len(take) < STEP and (len(found) < k or bounds[falling[done]] >= found[0][0][0]):
                        take.extend(members[falling[done]])
                        done += 1
                    if not take:
                        break
                    take = np.array(take)
                    lengths = size[take]
                    each = np.arange(lengths.sum()) + np.repeat(starts[take] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
                    totals = np.add.reduceat(score[each] * is_term[terms[each]], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                    for d, total in zip(take.tolist(), totals.tolist(), strict=True):
                        if total <= 0:
                            continue
                        entry = (_rank_key(total, ids[d]), ids[d])
                        if len(found) < k:
                            heapq.heappush(found, entry)
                        elif entry[0] > found[0][0]:
                            heapq.heapreplace(found, entry)
                is_term[own] = False

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                part = part.filter(pa.compute.greater(pa.compute.list_value_length(part["terms"]), 0))
                if part.num_rows:
                    lengths = pa.compute.list_value_length(part["terms"]).to_numpy(zero_copy_only=False)
                    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                    flat = [part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
                    search(part["doc_id"].to_pylist(), part["n"].to_numpy(zero_copy_only=False), *flat, starts)
        rows = [(number, doc_id, key[0]) for number, found in enumerate(best) for key, doc_id in found]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_no", "doc_id", "score"])

    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(per_task, "item_no int, doc_id bigint, score bigint")


def _search(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    postings = written(counted(docs, vocabulary))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # no more than the vocabulary
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having.get(i, 0) + 1))) for i in range(len(vocabulary))]
    found = best_of_tasks(postings, [[place[t] for t in terms] for _, terms in block], weights, n_docs, max(n_terms, 1), k)

    falling = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = Window.partitionBy("item_no", F.pmod(F.spark_partition_id(), F.lit(256))).orderBy(*falling)
    found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*falling))).where(F.col("rank") <= k)
    found = written(found.select("item_no", "rank", "doc_id", "score"))
    discard(postings)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item_no int, item_id bigint")
    return found.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, most_items: int = ITEMS_AT_ONCE, most_terms: int = TERMS_AT_ONCE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest scores above 0 for each row of items, equal
    scores by ascending doc_id.

    docs has doc_id (a whole number) and text, items item_id and text; other columns are ignored. A null text has no
    terms; a document without terms counts nowhere, an item without terms gets no rows. Repeated rows are documents, or
    items, of their own: a repeated item is answered as often as it stands there. A document without an id comes after all
    others of its score. Empty tables give no rows.
    """
    out = None
    for block in blocks(items, most_items, most_terms):
        found = _search(docs, block, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

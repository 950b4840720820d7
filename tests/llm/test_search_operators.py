"""MinHash near-duplicates, lexical search and hard negatives against brute-force versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lettercrate.llm import lexical, minhash, negatives

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- MinHash near-duplicates


def shingles(text: str | None, width: int = 4) -> set[str]:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_components(rows: list[tuple]) -> Counter:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[root(i)].append(doc_id)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        least = min(groups[root(i)], default=None)
        found.append((doc_id, len(sets[i]), least, doc_id == least))
    return Counter(found)


def edited(words: list[str], n: int, rng: random.Random) -> str:
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies() -> list[tuple]:
    """Groups of copies with so many edits that similarities lie around 0.8, chains and awkward texts among them."""
    rng, rows = random.Random(5), []
    for size in (2, 3, 7, 30, 90):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 150, 400]))]
        rows += [(len(rows) + k, edited(base, rng.randrange(1 + len(base) // 25), rng)) for k in range(size)]
    chain = [f"c{i}" for i in range(300)]
    for k in range(12):  # each is like the next, the ends aren't alike
        rows.append((len(rows), " ".join(chain[k * 8 : k * 8 + 200])))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \t\n", "one", "ONE", "one two", "a b c d", "A\x0bb  c\nd", "ſ é", "S é", "x " * 5000, "x x x x"])]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, "alone of its kind here"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [5, 1024])
def test_minhash_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, digest string, node int").repartition(3)
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == brute_components(rows)


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.near_duplicates(blank).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_signatures_agree_as_often_as_sets_are_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, shared in ((30, 20), (300, 200), (5000, 4000)):
        agree = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = minhash.signatures([np.unique(h[:n]), np.unique(h[n - shared :])])
            agree.append(np.mean(a == b))
        likeness = shared / (2 * n - shared)
        assert abs(np.mean(agree) - likeness) < 0.02
        assert np.std(agree) < 1.2 * (likeness * (1 - likeness) / minhash.SLOTS) ** 0.5


def test_signatures_dont_depend_on_what_is_worked_out_together():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 17, 400, 3000)]
    alone = np.concatenate([minhash.signatures([s]) for s in sets])
    assert (minhash.signatures(sets) == alone).all()
    assert (alone >> np.uint64(32) < minhash.SLOTS).all()  # every slot has a value


def test_parities_never_differ_in_more_bits_than_sets_do_in_elements():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, changed in ((1, 0), (40, 3), (300, 120), (5000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
        x, y = minhash._parities([a, b])
        turned = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert turned <= len(np.setxor1d(a, b)) and (changed == 0 or turned > 0)


def test_bands_and_sketches_hold_their_bounds():
    assert minhash.band_rows() == 5 and (1 - 0.8**5) ** (256 // 5) < 1e-8
    assert minhash.band_rows(100) == 32 and minhash.band_rows(1) == 1
    assert 48 < minhash.most_different() < 100


# --- lexical search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(i, Counter(TERMS.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        wanted, found = set(TERMS.findall((text or "").translate(LOWER))), []
        for doc_id, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(found[:k], 1)]
    return out


def search_fixture() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(8)
    word = lambda: f"t{int(rng.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(600)]
    docs += [(600 + i, docs[5][1]) for i in range(40)]  # ties
    docs += [(700, None), (701, ""), (702, "-- !?"), (703, "T1 t1 T1_t2.t3"), (704, "é É ß 日本 t1"), (705, "t1 " * 30_000), (703, "t1 again"), (None, docs[3][1]), (None, docs[3][1])]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 90])))) for i in range(30)]
    items += [(100, None), (101, "?!"), (102, "unheard of"), (103, docs[5][1]), (104, " ".join(f"t{i}" for i in range(300))), (103, docs[5][1]), (None, "t7 t8"), (105, "É 日本")]
    return docs, items


@pytest.mark.parametrize(("batch", "step", "most_items"), [(7, 2, 4), (4096, 64, 1000)])
def test_search_against_brute_force(spark, monkeypatch, batch, step, most_items):
    monkeypatch.setattr(lexical, "BATCH", batch)
    monkeypatch.setattr(lexical, "STEP", step)
    docs, items = search_fixture()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, item_id int, terms string").repartition(5)
    wanted = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int").repartition(2)
    got = lexical.search(frame, wanted, most_items=most_items).collect()
    assert Counter(map(tuple, got)) == Counter(brute_search(docs, items))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_blocks_of_items_are_bounded(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(20)], "item_id bigint, text string").coalesce(1)
    found = list(lexical.blocks(items, most_items=6, most_terms=30))
    assert sorted(i for b in found for i, _ in b) == list(range(20))
    assert all(len(b) <= 6 and (len(b) == 1 or sum(len(t) for _, t in b) <= 30) for b in found)


def test_masks_group_documents_by_the_terms_that_they_have():
    import numpy as np

    bits = np.random.default_rng(4).integers(0, 2, (70, 50)).astype(np.uint8)
    bits[:, 10], bits[:, 20], bits[:, 30] = bits[:, 0], bits[:, 0], 0
    masks, members = lexical._groups(bits)
    assert sorted(int(d) for m in members for d in m) == [d for d in range(50) if d != 30]
    assert all((bits[:, d] == mask).all() for mask, m in zip(masks, members, strict=True) for d in m) and [0, 10, 20] in [sorted(m.tolist()) for m in members]


# --- hard negatives


def brute_negatives(rows: list[tuple]) -> Counter:
    table = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        table.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for anchor, v, label in table:
        if anchor % 50:
            continue
        others = sorted((-score(v, w), i, same == label) for i, w, same in table if i != anchor)
        for down, positive, _ in [x for x in others if x[2]][:5]:
            fits = [(d, i) for d, i, same in others if not same and 50 * -down <= 100 * -d <= 95 * -down]
            for rank, (d, i) in enumerate(fits[:3], 1):
                out[anchor, positive, rank, i, -down, -d] += 1
    return out


def negatives_fixture() -> list[tuple]:
    rng = random.Random(11)
    around = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in around[i % 10]], i % 10 if rng.random() < 0.7 else rng.randrange(10)) for i in range(700)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.25], i % 3) for i in range(60)]  # ties; 1000 and 1050 are anchors
    rows += [(1100, [0.0] * 8, 1), (1150, [-x for x in around[2]], 2), (1200, [1.5, 2.0], 3), (1250, [], 3), (1300, [1e4] * 8, 4), (1301, [1e4] * 8, 5), (1302, [9e3] * 8, 4)]
    rows += [(1400, None, 1), (1401, [1.0, None] * 4, 1), (1402, [math.nan] * 8, 1), (1403, [math.inf] + [0.0] * 7, 1), (1450, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    return [*rows, rows[50], rows[51], rows[50]]


@pytest.mark.parametrize(("anchors", "rows_", "at_once"), [(5, 60, 16), (1024, 4096, 1024)])
def test_negatives_against_brute_force(spark, monkeypatch, anchors, rows_, at_once):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows_), ("AT_ONCE", at_once)):
        monkeypatch.setattr(negatives, name, value)
    rows = negatives_fixture()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, row int, anchor int").repartition(3)
    df = df.withColumn("embedding", df.embedding.cast("array<float>")) if anchors == 5 else df
    if anchors == 5:
        rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = Counter(tuple(r) for r in negatives.mine(df).collect())
    assert got == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], kind)).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], kind)).count() == 0  # an anchor without positives


def test_products_are_exact_beyond_doubles():
    import numpy as np

    a = np.array([[(1 << 26) - 1, 1, 1 << 26]] * 2)
    assert negatives._products(a, a)[0, 0] == ((1 << 26) - 1) ** 2 + 1 + (1 << 52)

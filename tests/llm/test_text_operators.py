"""Each operator against a brute-force version, on small tables with the awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lettercrate.llm import fingerprints, quality_rules, secret_scans, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog and runs away from it while rain falls on the old stone bridge near town".split()


def prose(n: int, seed: int = 1) -> str:
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[(x >> 8) % len(PROSE)] + ("." if x % 7 == 0 else ""))
    return " ".join(out)


TEXTS = [
    (1, prose(120, 3)),
    (2, prose(80, 4) + "\n\nÉtré ñandú 日本語 ẞ x\n" + prose(40, 5)),
    (3, prose(120, 3)),
    (3, prose(120, 3)),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one"),
    (8, "a b c a b c a b c"),
    (9, "x " * 3000),
    (10, "same line\nsame line\n \nsame line \nother\n" + prose(60, 6)),
    (11, "Token: 'abc123' and PASSWORD=short1, passwd=tiny5 api-key api_key = \"Zz9+/_.=-0\" ſecret=abcdefgh secret:xyz"),
    (12, "AKIA" + "B7" * 9 + " AKIAshort " + "deadbeef" * 4 + "g é " + "0" * 23 + " " + "a1" * 12),
    (13, "#*$%&|<> " * 20 + prose(60, 7)),
    (14, prose(20000, 8)),
    (None, prose(70, 9)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "clash") for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, findings string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# --- quality rules


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def signed(n, bits=64):
    return n - (1 << bits) if n >> (bits - 1) else n


def test_quality_counts_and_verdict(spark, docs, nothing):
    trusted = spark.createDataFrame([(1,), (1,), (2,), (None,), (99,)], "doc_id bigint")
    got = quality_rules.judge(docs, trusted).collect()
    assert len(got) == len(TEXTS)
    want = Counter((i, *counts(t)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.n_grams == max(0, 2 * r.n_words - 1)
        assert not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert quality_rules.judge(nothing, trusted).count() == 0


def test_quality_ratio_against_brute_force(spark):
    rows = [(1, "good words here good words"), (2, "bad noise bad noise bad noise"), (3, "good noise"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    got = {r.doc_id: r.score for r in quality_rules.judge(df, trusted).collect()}
    # distinct n-grams fall into distinct buckets here, so they can stand for them
    of = lambda t: (w := (t or "").split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    raw = Counter(g for _, t in rows for g in of(t))
    good = Counter(of(rows[0][1]))
    s = quality_rules.SMOOTHING
    ratio = {g: math.log((good[g] * sum(raw.values()) / sum(good.values()) + s) / (raw[g] + s)) for g in raw}
    for i, t in rows:
        want = sum(ratio[g] for g in of(t)) / len(of(t)) if of(t) else None
        assert got[i] == pytest.approx(want, abs=2e-6) if want is not None else got[i] is None
    assert got[1] > got[3] > got[2]


def test_quality_without_trusted_documents_keeps_by_base_rules(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint")
    for r in quality_rules.judge(docs, none).collect():
        assert r.kept == (not r.base_failed)
    kept = quality_rules.keep(docs, none)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for _, t in TEXTS if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0])


def test_quality_buckets_grow_with_the_corpus(spark, docs):
    few = spark.createDataFrame([(1, "a b c a b")], "doc_id bigint, text string")
    assert quality_rules.bits_for(few) == quality_rules.LEAST_BITS
    many = spark.range(1200).select("id", F.expr("concat_ws(' ', transform(sequence(0, 499), x -> concat('w', id * 500 + x)))").alias("text"))
    word_bits, pair_bits = quality_rules.bits_for(many, 1.0)  # 600,000 words and about as many pairs
    assert (word_bits, pair_bits) == (20, 20)
    # no bound: where words need more bits than a mark of 32 holds, the mark is the whole hash
    assert quality_rules.bits_for(many, 1e-5) == (36, 36)
    wide = docs.select("doc_id", quality_rules._marks_of(F.col("text"), 36).alias("m"))
    assert wide.schema["m"].dataType.simpleString() == "array<bigint>"


def test_quality_scores_with_many_buckets_and_many_trusted_ids(spark, docs, monkeypatch):
    trusted = spark.createDataFrame([(1,), (2,), (None,)], "doc_id bigint")
    as_set = lambda df: Counter((r.doc_id, r.kept, r.n_words, r.score is None) for r in df.collect())
    want = as_set(quality_rules.judge(docs, trusted, load=1.0))
    assert as_set(quality_rules.judge(docs, trusted, load=1e-9)) == want  # buckets of 40 bits or more, in a merge join
    monkeypatch.setattr(quality_rules, "MOST_IDS", 1)
    assert as_set(quality_rules.judge(docs, trusted, load=1.0)) == want


def test_quality_scores_are_the_same_by_either_join(spark, docs):
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    by_broadcast = quality_rules.judge(docs, trusted).where("not base_failed or base_failed")
    by_merge = quality_rules.judge(docs, trusted, most_broadcast=0)
    as_set = lambda df: Counter((*r[:-1], r.score is not None and round(r.score, 9)) for r in df.collect())
    assert as_set(by_merge) == as_set(by_broadcast)
    assert by_merge.columns == by_broadcast.columns and by_merge.where("kept").count() == by_broadcast.where("kept").count()


def test_repeats_are_exact_in_a_very_long_text(spark):
    n = 5_000_000
    df = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {n}), x -> hex(x)), ' ')").alias("text"))
    got = quality_rules.with_counts(df).select("n_words", "n_repeat_words").first()
    assert (got.n_words, got.n_repeat_words) == (n, 0)


def test_kept_rows_have_all_their_columns(spark, docs):
    wide = docs.select("*", *[F.lit(c).alias(c) for c in ("_row", "kept", "n_words", "_sum", "score")])
    kept = quality_rules.keep(wide, spark.createDataFrame([(1,)], "doc_id bigint"))
    assert kept.columns == wide.columns
    assert {r.kept for r in kept.collect()} == {"kept"} and kept.where("text is null").count() == 0


# --- secrets


def base_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_against_brute_force(spark, docs, nothing):
    from lettercrate.llm.common import shared_dir

    ledger = secret_scans.update_ledger(docs, shared_dir(spark))
    assert ledger.count() == len({t or "" for _, t in TEXTS})
    got = secret_scans.findings_by_path(docs, ledger, secret_scans.BASE_RULES)
    assert got.columns.count("findings") == 1 and got.count() == len(TEXTS)
    texts = Counter((i, base_spans(t or "")) for i, t in TEXTS)
    assert Counter((r[0], r[1]) for r in got.select("doc_id", secret_scans.as_text(F.col("findings"))).collect()) == texts
    assert any("assign" in s and "access" not in s for _, s in texts) and any("hex" in s and "access" in s for _, s in texts)
    assert secret_scans.findings_by_path(nothing, secret_scans.update_ledger(nothing, shared_dir(spark))).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    from lettercrate.llm.common import shared_dir

    root, old = shared_dir(spark), secret_scans.BASE_RULES[:2]
    first = spark.createDataFrame([("a", 1, "token = abcdefgh"), ("b", 1, "nothing"), ("c", 1, "token = abcdefgh")], "path string, version int, text string")
    assert secret_scans.update_ledger(first, root, old).count() == 2
    assert secret_scans.update_ledger(first, root, old).count() == 2  # all seen
    second = first.union(spark.createDataFrame([("a", 2, "hex " + "0f" * 12)], first.schema))
    both = secret_scans.update_ledger(second, root, old)
    assert both.count() == 3
    ledger = secret_scans.update_ledger(second, root)  # new rules: all blobs, but for the new rules only
    assert ledger.count() == 6
    assert ledger.where(F.array_contains("versions", old[0].version)).count() == 3
    got = {(r.path, r.version): [x.kind for x in r.findings] for r in secret_scans.findings_by_path(second, ledger).collect()}
    assert got == {("a", 1): ["assign"], ("b", 1): [], ("c", 1): ["assign"], ("a", 2): ["hex"]}
    clean = {(r.path, r.version): r.text for r in secret_scans.redact(second, ledger).collect()}
    assert clean == {("a", 1): "<secret>", ("b", 1): "nothing", ("c", 1): "<secret>", ("a", 2): "hex <secret>"}


def test_redaction_merges_overlaps_and_counts_anew(spark):
    from lettercrate.llm.common import shared_dir

    text = 'é token = "' + "0f" * 20 + '" end'
    df = spark.createDataFrame([(1, text, len(text)), (2, None, 0)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scans.redact(df, secret_scans.update_ledger(df, shared_dir(spark))).collect()}
    assert out == {1: ('é <secret>" end', 15), 2: (None, 0)}


def test_ledger_is_the_same_however_many_blobs_are_new(spark, docs, monkeypatch):
    from lettercrate.llm.common import shared_dir

    ledgers = []
    for few in (0, 100_000):
        monkeypatch.setattr(secret_scans, "FEW_BLOBS", few)
        root = shared_dir(spark)
        secret_scans.update_ledger(docs.where("doc_id < 9"), root)
        ledger = secret_scans.update_ledger(docs, root)
        ledgers.append(Counter((r.blob, tuple(r.versions), tuple(map(tuple, r.findings))) for r in ledger.collect()))
    assert ledgers[0] == ledgers[1] and max(ledgers[0].values()) == 1 and len(ledgers[0]) == len({t or "" for _, t in TEXTS})


@pytest.mark.parametrize("text", ["eyJ" * 700_000, "eyJaaaaaaaa." * 200_000, "token " * 300_000, "AKIA" * 500_000, "://a:" * 400_000, "-----BEGIN " * 200_000])
def test_rules_read_hostile_texts_in_linear_time(text):
    began = time.perf_counter()
    for rule in secret_scans.RULES:
        sum(1 for _ in rule.compiled().finditer(text))
    assert time.perf_counter() - began < 10


def test_jwt_is_found_where_a_token_starts():
    rule = next(r for r in secret_scans.RULES if r.kind == "jwt")
    token = "eyJhbGciOi12.eyJzdWIiOi12.c2lnbmF0dXJl"
    assert [m[0] for m in rule.compiled().finditer(f"a {token} b={token}, x{token} eyJ.{token[:20]}")] == [token, token]


def test_redaction_keeps_columns_of_any_name(spark):
    from lettercrate.llm.common import shared_dir

    names = ["blob", "_starts", "_blob", "address", "row", "starts", "ends", "cleaned", "findings"]
    df = spark.createDataFrame([(i, "token = abcdefgh" if i % 2 else None, *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", *names])
    out = secret_scans.redact(df, secret_scans.update_ledger(df, shared_dir(spark)))
    assert out.columns == df.columns
    for r in out.collect():
        assert r.text == ("<secret>" if r.doc_id % 2 else None) and all(r[n] == f"{n}{r.doc_id}" for n in names)


# --- fingerprints


def edited(texts):
    """{(doc_id, text): (edited text, next text)} by the contract's order."""
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    out = {}
    for x, y in zip(order, [*order[1:], order[0]], strict=True):
        n = len(x[1]) // 3
        out.setdefault(x, []).append((x[1][: len(x[1]) - n] + y[1][:n], y[1]))
    return out


def syncmers(text, k=fingerprints.K, s=fingerprints.S):
    """Chosen k-mers as tuples of tokens: those whose least s-mer (by XXH64) is at an edge."""
    w = re.findall(r"[぀-ヿ一-鿿]|[^\x20\x09-\x0D぀-ヿ一-鿿]+", text)
    if len(w) < k:
        return {tuple(w)} if w else set()

    def chained(words):
        seed = 42
        for x in words:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return signed(seed)

    out = set()
    h = [chained(w[i : i + s]) for i in range(len(w) - s + 1)]
    for i in range(len(w) - k + 1):
        inner = h[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.add(tuple(w[i : i + k]))
    return out


def test_fingerprints_against_brute_force(spark, docs, nothing):
    got = fingerprints.compare_with_edits(docs).collect()
    want = edited([(i, t or "") for i, t in TEXTS])
    assert len(got) == len(TEXTS)
    by_id = {}
    for (i, t), found in want.items():
        by_id.setdefault(i, []).extend((t, *f) for f in found)
    near = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for r in got:
        options = by_id[r.doc_id]
        hit = [o for o in options if hashlib.sha256(o[1].encode()).hexdigest() == r.edited_sha256]
        assert hit, r.doc_id
        text, other, following = hit[0]
        assert r.n_chars == len(text)
        a, b = syncmers(text), syncmers(other)
        assert r.n_anchors == len(a) == len(r.fingerprint.split())
        assert len(b) == len(r.edited_fingerprint.split())
        assert r.near_edited == pytest.approx(near(a, b))
        assert any(r.near_next == pytest.approx(near(a, syncmers(o[2]))) for o in hit)
    same = {r.fingerprint for r in got if r.doc_id in (1, 3)}
    assert len(same) == 1
    assert fingerprints.compare_with_edits(nothing).count() == 0


def test_many_ranges_find_the_same_neighbours(spark):
    rows = [(i * i % 1013, f"text number {i}") for i in range(300)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranges = fingerprints.in_ranges(df, rows_per_range=7)
    assert ranges.select("_range").distinct().count() > 20
    got = ranges.withColumn("next", F.lead("text").over(fingerprints.in_order())).where("_own").select("doc_id", "text", "next").collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    assert Counter(map(tuple, got)) == Counter((*x, y[1]) for x, y in zip(order, [*order[1:], order[0]], strict=True))


def test_ranges_of_rows_without_an_id_and_of_many_cuts(spark):
    rows = [(i, f"text {i}") for i in range(0, 5000, 7)] + [(None, f"bare {i % 90}") for i in range(120)]
    for some in (rows, rows[:1], [r for r in rows if r[0] is None], [(None, "a")], [(5, "a"), (5, "b"), (5, "a")]):
        df = spark.createDataFrame(some, "doc_id bigint, text string")
        got = fingerprints.in_ranges(df, rows_per_range=3)
        got = got.withColumn("next", F.lead("text").over(fingerprints.in_order())).where("_own").select("doc_id", "text", "next").collect()
        order = sorted(some, key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
        assert Counter(map(tuple, got)) == Counter((*x, y[1]) for x, y in zip(order, [*order[1:], order[0]], strict=True))


def test_cuts_in_two_levels(spark):
    ids = spark.range(0, 6000, 2).select(F.col("id").alias("doc_id"))
    lists = fingerprints._cuts(ids, 2500)
    flat = [x for part in lists for x in part]
    assert flat == sorted(set(flat)) and flat[-1] == 5998 and len(lists) > 900 and len(flat) > 2000


def test_unspaced_scripts_are_cut_at_letters(spark):
    text = "今日は天気がいいから散歩しましょうと彼は言ったが雨が降ってきたので家に帰って本を読んだ" * 2
    df = spark.createDataFrame([(1, text), (2, "前" + text)], "doc_id bigint, text string")
    a, b = (set(x.hash for x in r.found) for r in fingerprints.anchors(df, "text", "found").orderBy("doc_id").collect())
    assert len(a) > 5 and len(a & b) > 0.8 * len(a)


def test_first_matches_grow_with_the_anchors(spark):
    passage = prose(60, 11)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(10 + i)) + " " + passage) for i in range(40)] + [(None, passage)], "doc_id bigint, text string")
    got = fingerprints.first_matches(fingerprints.anchors(df, "text", "anchors"), 5).collect()
    assert {(r.doc_id, r.first_id, r["shift"]) for r in got} == {(i, 0, -i) for i in range(1, 40)} and len(got) == 39


def test_positional_matching_finds_a_moved_passage(spark):
    passage = prose(60, 11)
    df = spark.createDataFrame([(1, prose(30, 12) + " " + passage), (2, passage + " " + prose(20, 13)), (3, prose(90, 14) + " odd")], "doc_id bigint, text string")
    rows = fingerprints.anchors(df, "text", "anchors")
    best = fingerprints.matches(rows.where("doc_id = 1"), rows.where("doc_id = 2"), 5).orderBy(F.desc("n_anchors")).first()
    assert (best.left_id, best.right_id, best["shift"]) == (1, 2, -30)


def test_every_text_with_words_has_an_anchor(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(7 + i % 4))) for i in range(80)] + [(80, "  ")]
    df = fingerprints.anchors(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", "found", always=True)
    got = {r.doc_id: [tuple(x) for x in r.found] for r in df.collect()}
    assert got.pop(80) == [] and all(got.values())
    bare = [i for i, t in rows[:80] if not syncmers(t)]
    assert len(bare) > 20 and all(len(got[i]) == 1 for i in bare)
    assert len({got[i][0][1] for i in bare}) == len(bare)  # unrelated texts share none


# --- SimHash


def simhash_of(text):
    w = [x.encode() for x in WORDS.findall(text or "")]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(marks, radius=2):
    """{mark: least mark linked} by comparing all pairs."""
    marks, root = sorted(set(marks)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {m: find(m) for m in marks}


def test_simhash_against_brute_force(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    marks = [(i, simhash_of(t)) for i, t in TEXTS]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{m:016x}") for i, m in marks)
    root = classes(m for _, m in marks)
    least = {}
    for i, m in marks:
        if i is not None:
            least[root[m]] = min(i, least.get(root[m], i))
    for r in got:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])
    assert simhash.near_duplicates(nothing).count() == 0
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ("_id", "_hash", "id", "hash", "row", "fingerprint")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == len({root[m] for _, m in marks})


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    a, b = prose(90, 31), prose(90, 32)
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [(1, a), (2, b)]
    df = spark.createDataFrame([(2, a), (2, b)], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == sorted([a, b])


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_links_lose_none_however_crowded(spark, crowd):
    import random

    rng = random.Random(5)
    marks = [rng.getrandbits(64) for _ in range(60)]
    for m in list(marks[:12]):
        x = m
        for _ in range(12):  # chains and clusters around some of them
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            marks += [x, x ^ (1 << rng.randrange(64)) ^ (1 << 63)]
    marks += [0, 1, 3, (1 << 64) - 1, 1 << 63]
    df = spark.createDataFrame([(signed(m),) for m in marks] + [(None,)], "fingerprint bigint")
    links = simhash.links(df, crowd=crowd)
    for r in links.collect():
        assert bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 2
    root = {r.node: r.root for r in simhash.components(links).collect()}
    got, want = {}, classes(marks)
    for m in want:
        got.setdefault(root.get(signed(m), signed(m)), set()).add(m)
    truth = {}
    for m, r in want.items():
        truth.setdefault(r, set()).add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, truth.values()))


def test_links_at_another_radius(spark):
    import random

    rng = random.Random(8)
    marks = {rng.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        marks |= {m ^ sum({1 << rng.randrange(64) for _ in range(k)}) for k in (1, 3, 4)}
    links = simhash.links(spark.createDataFrame([(signed(m),) for m in marks], "fingerprint bigint"), 3)
    got = {(r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)) for r in links.collect()}
    assert {tuple(sorted(x)) for x in got} == {(a, b) for a in marks for b in marks if a < b and bin(a ^ b).count("1") <= 3}


def test_masks_leave_no_pair_out():
    import itertools

    masks = [m & ((1 << 64) - 1) for m in simhash._masks(2)]
    assert len(masks) == 9
    for x, y in itertools.combinations(range(64), 2):
        assert any(not m & (1 << x | 1 << y) for m in masks)


def test_hot_keys_meet_a_broadcast_and_no_row_is_lost(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    rows = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    got = simhash.looked_up(rows, table, "k").collect()
    assert sorted((r.id, r.k, r.v) for r in got) == [(i, k := 0 if i < 60 else i, 10 * k) for i in range(100)]


def test_pivots_never_discard_a_link():
    import random

    rng, pivots = random.Random(6), simhash.pivots()
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        d = lambda a, p: bin((a ^ p) & ((1 << 64) - 1)).count("1")
        assert max(abs(d(x, p) - d(y, p)) for p in pivots) <= 2


# --- substring dedup


def brute_units(text):
    """The words of every unit, by looking at one character after the other."""
    import zlib

    sentences, start, i = [], 0, 0
    while i < len(text):
        j = i
        if text[i] in ".!?…":
            while j < len(text) and text[j] in ".!?…":
                j += 1
            while j < len(text) and text[j] in "\"'”’)]":
                j += 1
            closes = j < len(text) and text[j].isspace()
        else:
            closes = text[i] == "\n"
        i = max(j, i + 1)
        if closes:
            sentences.append(text[start:i])
            start = i
    out = []
    for words in (s.split() for s in [*sentences, text[start:]]):
        unit = []
        for n, w in enumerate(words, 1):
            unit.append(w)
            if n == len(words) or len(words) > substring_dedup.LONGEST and (len(unit) == substring_dedup.LONGEST or zlib.crc32(w.encode()) % substring_dedup.CUT == 0):
                out.append(unit)
                unit = []
    return out


def test_units_against_a_cutter_by_characters():
    import random

    rng = random.Random(12)
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(["a", "b", " ", ".", "!", "…", ")", '"', "\n", "\t", " word", "é"]) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        assert [w for *_, w in substring_dedup._units(t, substring_dedup.LONGEST)] == brute_units(t)


@pytest.mark.parametrize("text", ["." * 5_000_000, ".)" * 1_000_000, "a.!" * 1_000_000, "x" * 3_000_000, "\n" * 2_000_000])
def test_units_of_hostile_texts_take_linear_time(text):
    began = time.perf_counter()
    substring_dedup._units(text, 20)
    assert time.perf_counter() - began < 5


def brute_removed(rows):
    """{(doc_id, text): numbers of removed units} by looking at all spans."""
    spans, docs = {}, sorted({(i if i is not None else 1 << 62, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t in rows})
    out = {}
    for i, h, t in docs:
        units = [" ".join(w) for w in brute_units(t)]
        n, found = len(units), set()
        size = lambda a, b: sum(u.count(" ") + 1 for u in units[a:b])  # noqa: E731,B023
        wide = lambda a, b: b - a >= substring_dedup.LEAST_UNITS and size(a, b) >= substring_dedup.LEAST_WORDS  # noqa: E731,B023
        for a in range(n):
            found |= {next(((a, b) for b in range(a + 1, n + 1) if wide(a, b)), None)}
        found = (found | {next(((a, n) for a in range(n - 1, -1, -1) if wide(a, n)), None)}) - {None}
        if not found and n:
            found = {(0, n)}
        out[(i, t)] = set()
        for a, b in sorted(found):
            key = " ".join(units[a:b])
            if key in spans and spans[key] < (i, h, a, b):
                out[(i, t)] |= set(range(a, b))
            spans[key] = min(spans.get(key, (i, h, a, b)), (i, h, a, b))
    return out


def test_substring_dedup_against_brute_force(spark, nothing):
    shared = "Here is a passage that many pages share. It has four sentences in all. Each of them is rather plain, to be sure. The last one closes it now and then goes on for a while."
    rows = [
        (1, f"Own start of one.\n{shared} Own end of one."), (2, f"{shared}\nNothing else is here but this."), (3, f"Three says so. {shared}\nAnd more. {shared} Again."),
        (4, prose(200, 21)), (5, prose(200, 21)), (5, prose(200, 21)), (6, "short one"), (7, "short one"), (8, ""), (9, None), (10, "  \n "),
        (11, "na " * 400), (None, prose(200, 21)), (12, "…"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, removed string").repartition(3)
    got = substring_dedup.remove_repeats(df).collect()
    want = brute_removed(rows)
    texts = dict(zip([r[0] for r in rows], [r[1] for r in rows], strict=True))
    assert len(got) == len(rows)
    for r in got:
        gone = want[(r.doc_id if r.doc_id is not None else 1 << 62, texts[r.doc_id] or "")]
        assert set(r.removed_units) == gone, r.doc_id
        assert (r.text is None) == (texts[r.doc_id] is None)
        assert r.removed_chars == len(texts[r.doc_id] or "") - len(r.text or "")
    by = {r.doc_id: r for r in got}
    assert by[1].text == texts[1] and by[4].text == texts[4] and by[6].text == "short one"
    assert "passage" not in by[2].text and "passage" not in by[3].text and "Three says so" in by[3].text
    assert by[5].text == "" and by[None].text == "" and by[7].text == ""
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_removes_short_sentences_that_end_a_passage(spark):
    # 20, 1, 1, 1, 1, 1 words: the forward run from the second sentence leaves the passage
    passage = " ".join(f"word{i}" for i in range(19)) + " end. Yes. No. So. But. Then."
    tails = [" ".join(f"{c}{i}" for i in range(15)) + "." for c in "pq"]
    df = spark.createDataFrame([(1, f"{passage} {tails[0]}"), (2, f"{passage} {tails[1]}")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert got[1] == f"{passage} {tails[0]}" and got[2] == tails[1]


def test_substring_dedup_finds_a_passage_with_two_whole_units(spark):
    # two sentences of 19 words, neither cut, with their neighbours cut off within: no run of three units repeats
    whole = " ".join(" ".join(f"{c}{i}" for i in range(19)) + "." for c in "ab")
    texts = {d: f"{d}one {d}two tail of a sentence. {whole} Head of another {d}three {d}four." for d in "xy"}
    df = spark.createDataFrame([(1, texts["x"]), (2, texts["y"])], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df, pair_words=substring_dedup.PAIR_WORDS).collect()}
    assert got[1] == texts["x"] and whole not in got[2] and "yone" in got[2] and "yfour" in got[2]


def test_substring_dedup_takes_no_single_sentence_for_a_run(spark):
    rows = [(1, "one two"), (2, "one two"), (3, "Yes. No."), (4, "Yes. No."), (5, prose(60, 3)), (6, prose(60, 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df, least_whole=2).collect()}
    assert got == {**dict(rows), 4: "", 6: ""}


def test_spans_carry_more_of_the_hash_than_64_bits(spark):
    text = "Here is a run of words. It has three sentences in all. That is enough."
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    for r in substring_dedup.spans(df).collect():
        long = xxhash.xxh3_128_intdigest(text.encode())
        assert (r.hash, r.check) == (signed(long & (1 << 64) - 1), signed(long >> 64 & (1 << 32) - 1, 32))


def test_units_join_to_the_text():
    for _, t in TEXTS:
        t = t or ""
        units = substring_dedup._units(t, 20)
        assert "".join(t[a:b] for a, b, _ in units).strip() == t.strip()
        assert [w for _, _, ws in units for w in ws] == re.findall(r"\S+", t)
        assert all(0 < len(ws) <= 20 for _, _, ws in units)

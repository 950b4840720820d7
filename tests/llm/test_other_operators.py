"""Packing, sharding, mixing, toxicity, URL filters and the pipeline on small tables."""

from __future__ import annotations

import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lettercrate.llm import mixing, packing, queries, secret_scans, sharding, toxicity, url_filters
from lettercrate.llm.common import shared_dir, written

TRICKY = [
    "", " ", "  a  b", "a \n b", "x\n\ny", " lead", "trail ", "<|endoftext|> hi", "it's  we'll", "a\tb \t c", "日本 語", "a.\nB c,\n d", "x \n", "\n", "a b c",
    "q. w.\n\nz", "1.2, 3", "é. à", "a\0b c", "plain words here.\nAnd more, they're 12x", " wide  space", "😀 ok",
]


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


# --- packing


def test_encoder_equals_the_tokenizers_library(tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    parts = ["<|endoftext|>", " ", "a", "\n", "<|", "|>", "  ", "é.", "\t"]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(500)] + ["".join(rng.choice("ab .,\n'é1\t") for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert packing._encoder(tokenizer)(texts) == want


def test_encoder_forgets_by_bytes(tokenizer, monkeypatch):
    packing._encoder.cache_clear()
    monkeypatch.setattr(packing, "MOST_REMEMBERED", 10_000)
    ids_of = packing._encoder(tokenizer)
    want = ids_of(["some words here", "x" * 200_000])
    for i in range(30):
        ids_of([" ".join(f"w{i}x{j}" for j in range(50))])
    assert ids_of(["some words here", "x" * 200_000]) == want
    packing._encoder.cache_clear()


def test_plan_places_everything_once():
    rng = random.Random(2)
    for trial in range(12):
        h = {rng.randrange(1, 1025): rng.randrange(1, 400) for _ in range(rng.choice([1, 3, 40, 300]))}
        groups = rng.choice([1, 5, 40])
        rows = packing.plan(dict(h), 1024, rng.choice([1, 96, 448, 1024]), groups)
        fill, seen = defaultdict(list), Counter()
        for x, a, b, sequence, offset in rows:
            seen[x] += b - a
            for r in range(a, b):
                fill[sequence + r - a].append((offset, x))
        assert seen == Counter(h), trial
        for places in fill.values():
            at = 0
            for offset, x in sorted(places):
                assert offset == at
                at += x
            assert at <= 1024
        assert sorted(fill) == list(range(len(fill)))
        best = -(-sum(k * n for k, n in h.items()) // 1024)
        halves = sum(n for k, n in h.items() if k > 512)
        assert groups < 40 or len(fill) <= 1.4 * max(best, halves) + 50


def test_pack_round_trip(spark, tokenizer):
    texts = [(i, t) for i, t in enumerate(TRICKY)] + [(100, "word " * 3000), (101, "tail of it " * 900), (101, "tail of it " * 900), (None, "no id"), (102, None)]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id bigint, text string, piece string, length int").repartition(3)
    cut = packing.pieces(docs, tokenizer).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in texts}
    again = defaultdict(list)
    for p in cut:
        again[p.doc_id].append(p)
    for (i, _), whole in ids.items():
        mine = sorted(again[i], key=lambda p: p.piece)
        assert {p.piece for p in mine} == set(range(-(-len(whole) // 1024)))
        for p in mine:
            assert bytes(p.ids) == whole[p.start : p.start + p.length].tobytes()
            assert p.length == 1024 or p.piece == 0
    got = packing.pack(docs, tokenizer).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == Counter((p.doc_id, p.piece, p.start, p.length, zlib.crc32(p.ids)) for p in cut)
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs.where("false"), tokenizer).count() == 0


def test_place_with_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)
    rows = written(spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 300 + 1).cast("bigint").alias("length")))
    got = packing.place(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 2000 == len({r.id for r in got})


# --- sharding


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(3)
    texts = [(i, "é" * rng.randrange(0, 400), "x") for i in range(3000)] + [(5, "dup", "x"), (5, "dup", "x"), (None, None, "x"), (7000, "", "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, shard string")
    rows = sharding.with_slots(df).drop("text")
    first = sharding.first_map(sharding.slot_sizes(rows), 8)
    root = shared_dir(spark)
    sharding.save_map(spark, first, root)
    got = sharding.assign(rows, sharding.load_map(spark, root)).collect()
    assert len(got) == len(texts)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in texts)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    grown = sharding.edited_map(first, sharding.slot_sizes(rows), 9)
    sharding.save_map(spark, grown, root)
    assert sharding.load_map(spark, root)[0][0] == 2 and sharding.load_map(spark, root, 1) == first
    before, after = {x[1]: x[2] for x in first}, {x[1]: x[2] for x in grown}
    moved = [s for s in before if before[s] != after[s]]
    assert moved and len(moved) < len(before) / 4
    sizes = Counter()
    for _, _, shard, n, _ in grown:
        sizes[shard] += n
    assert len(sizes) == 9 and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 9 + max(x[3] for x in grown)
    assert sharding.first_map([], 8) == []
    assert sharding.assign(rows.where("false"), first).count() == 0


def test_written_shards_hold_all_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id bigint, text string")
    mapping = sharding.first_map(sharding.slot_sizes(sharding.with_slots(df)), 3)
    path = shared_dir(spark)
    sharding.write_shards(df, mapping, path)
    back = spark.read.parquet(path)
    assert back.select("shard").distinct().count() == 3
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))


def test_a_map_has_a_shard_for_rows_that_come_later(spark):
    few = spark.createDataFrame([(i, f"t{i}", "mine") for i in range(200)], "doc_id bigint, text string, shard string")
    more = spark.createDataFrame([(i, f"t{i}", "mine", i) for i in range(400)] + [(None, f"n{i % 50}", "mine", 0) for i in range(100)], "doc_id bigint, text string, shard string, number long")
    mapping = sharding.first_map(sharding.slot_sizes(sharding.with_slots(few)), 3)
    assert [x[1] for x in mapping] == list(range(sharding.SLOTS))
    assert max(Counter(x[2] for x in mapping).values()) <= sharding.SLOTS / 3 + 1
    path = shared_dir(spark)
    sharding.write_shards(more, mapping, path)
    back = spark.read.parquet(path)
    assert Counter(r.doc_id for r in back.collect()) == Counter([*range(400), *[None] * 100])
    rows = sharding.with_slots(more).withColumn("slot", F.lit("mine")).withColumn("_start", F.lit(1))
    second = sharding.edited_map(mapping, sharding.slot_sizes(rows), 3)
    got = sharding.assign(rows, second)
    assert got.columns == ["doc_id", "text", "number", "virtual_slot", "size", "_start", "shard", "slot", "map_version"]
    got = got.collect()
    assert len(got) == 500 and all(r.shard is not None for r in got)
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert rows.where("doc_id is null").select("virtual_slot").distinct().count() > 30
    for refused in (lambda: sharding.assign(rows, mapping[1:]), lambda: sharding.write_shards(more, mapping[:-1], shared_dir(spark))):
        with pytest.raises(ValueError, match="lacks"):
            refused()


def test_slots_are_gapless_with_a_map_of_other_rows(spark):
    few = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id bigint, text string")
    more = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id bigint, text string")
    got = sharding.assign(sharding.with_slots(more), sharding.first_map(sharding.slot_sizes(sharding.with_slots(few)), 3)).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and slots
    assert sorted(r.doc_id for r in got) == list(range(4000))


# --- mixing


def test_exponent_meets_entropy_and_repetition():
    tokens = {"a": 900, "b": 80, "c": 20}
    a = mixing.find_exponent(tokens, 0.8, None)
    assert mixing.entropy(mixing.weights_at(tokens, a)) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    a = mixing.find_exponent(tokens, None, 2.0)
    assert max(mixing.epochs_of(tokens, mixing.weights_at(tokens, a), None).values()) == pytest.approx(2.0, abs=1e-6)
    assert mixing.find_exponent(tokens, None, None) == 1.0
    assert mixing.find_exponent(tokens, 1.0, None) == pytest.approx(0, abs=1e-9)
    a = mixing.find_exponent(tokens, 1.0, 2.0)
    assert max(mixing.epochs_of(tokens, mixing.weights_at(tokens, a), None).values()) == pytest.approx(2.0, abs=1e-6)
    assert mixing.find_exponent({"a": 5}, 0.9, 1.5) in (0.0, 1.0)
    assert mixing.find_exponent(tokens, 0.99, 3.0, budget=1000) <= 1


def test_mixture_against_its_definition(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", 7)
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else "small" if i % 2 else None, 0) for i in range(240)] + [(1, "w w", "big", 0), (1, "w w", "big", 0), (500, None, "big", 0), (None, "", "tiny", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, epoch int").repartition(3)
    got = mixing.mix(mixing.prepare(df), target_entropy=1.0, most_epochs=2.5, block_tokens=200).collect()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += max(1, len((t or "").split()))
    weights = mixing.weights_at(tokens, mixing.find_exponent(tokens, 1.0, 2.5))
    epochs = mixing.epochs_of(tokens, weights, None)
    read, blocks = Counter(), defaultdict(Counter)
    for r in got:
        read[r.source] += r.tokens
        blocks[r.source][r.block] += r.tokens
    for s, e in epochs.items():
        budget = e * tokens[s]
        assert budget - 1e-6 <= read[s] < budget + 9, s
        per = weights[s] * 200
        for b, n in list(blocks[s].items())[:-1]:
            assert n < per + 10 and (b == max(blocks[s]) or n > per - 10)
    once = Counter((r.doc_id, r.source) for r in got if r.epoch == 0)
    assert once == Counter((i, s) for i, _, s, _ in rows)  # each row is read at least once
    first = [(r.doc_id, r.source, r.epoch, r.block) for r in got]
    assert Counter(first) == Counter((r.doc_id, r.source, r.epoch, r.block) for r in mixing.mix(mixing.prepare(df.repartition(5)), 1.0, 2.5, block_tokens=200).collect())
    assert mixing.mix(mixing.prepare(df.where("false"))).count() == 0
    few = mixing.mix(mixing.prepare(df), budget=100, target_entropy=None, most_epochs=None).agg(F.sum("tokens")).first()[0]
    assert 100 <= few <= 100 + 9 * 4


def test_mixture_keeps_columns_of_any_name_and_refuses_too_many_sources(spark):
    names = ["number", "row", "hash", "range", "at", "before", "base", "epochs", "budget", "_number"]
    df = spark.createDataFrame([(i, f"w {i}", f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(30)], ["doc_id", "text", "source", *names])
    got = mixing.mix(written(mixing.prepare(df)))
    assert got.columns == [*df.columns, "tokens", "key", "epoch", "block", "block_order"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
    with pytest.raises(ValueError, match="sources"):
        mixing.source_tokens(mixing.prepare(df), 2)


# --- toxicity


def test_toxicity_learns_from_the_rows_it_may(spark):
    rng = random.Random(4)
    plain = "river stone bridge garden window letter morning evening paper table".split()
    rows, labels = [], []
    for i in range(900):
        words, bad = [rng.choice(plain) for _ in range(rng.randrange(1, 60))], i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grubling", "snotface"]))
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, None, int(bad)))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "grubling " * 40_000, "x"), (None, "river", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(4)
    labels = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    train = toxicity.training_rows(docs, labels)
    assert {zlib.crc32(str(r.doc_id).encode()) % 3 for r in train.collect()} == {0, 2}
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i in held if (got[i] >= 0.7) != (i % 4 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    assert got[5002] >= 0.7 > got[5000] and got[5000] == got[5001]
    again, b = toxicity.train(docs.repartition(7), labels)
    assert np.allclose(model[0], again, atol=1e-5) and b == pytest.approx(model[1], abs=1e-5)
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score < 0.7 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(docs.where("false"), none).count() == 0


def test_buckets_do_not_depend_on_parts():
    text = "Größe of a Text, with some words " * 50
    whole = set()
    for n in toxicity.SIZES:
        padded = f" {text.lower()} "
        grams = {padded[i : i + n] for i in range(len(padded) - n + 1)}
        for g in grams:
            code = 0
            for c in g:
                code = (code * toxicity.SPREAD + ord(c)) % (1 << 64)
            whole.add(((code + n) * toxicity.LAST % (1 << 64)) >> 44)
    assert set(toxicity.buckets_of(text).tolist()) == whole


def test_toxicity_against_brute_force(spark):
    """Ratios, fit and scores from the definitions: n-grams as strings, plain Python numbers."""
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "vile", "nasty"][: 6 if i % 3 == 0 else 4]) for _ in range(12))) for i in range(150)]
    labels = [(i, 1, int(i % 3 == 0)) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    def grams(text):
        padded = f" {text.lower()} "
        return {padded[i : i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)}

    mine = [(grams(t), int(i % 3 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    n_pos = sum(y for _, y in mine)
    n_neg = len(mine) - n_pos
    p, n = Counter(g for f, y in mine if y for g in f), Counter(g for f, _ in mine for g in f)
    r = {}
    for g in n:
        pos, neg = p[g] + 0.5, n[g] - p[g] + 0.5
        x = math.log(pos / (n_pos + 1)) - math.log(neg / (n_neg + 1))
        size = max(abs(x) - toxicity.CERTAIN * math.sqrt(1 / pos + 1 / neg), 0) if n[g] >= toxicity.LEAST_DOCS else 0
        if size:
            r[g] = math.copysign(size, x)
    w, m, v, b, mb, vb = dict.fromkeys(r, 0.0), dict.fromkeys(r, 0.0), dict.fromkeys(r, 0.0), 0.0, 0.0, 0.0
    known = [([g for g in f if g in r], y) for f, y in mine]
    for k in range(1, 121):
        grad, gb = dict.fromkeys(r, 0.0), 0.0
        for f, y in known:
            e = 1 / (1 + math.exp(-(b + sum(w[g] * r[g] for g in f)))) - y
            gb += e / len(known)
            for g in f:
                grad[g] += e * r[g] / len(known)
        rate = 0.05 / (1 + k / 60)
        for g in r:
            d = grad[g] + 1e-4 * w[g]
            m[g], v[g] = 0.9 * m[g] + 0.1 * d, 0.999 * v[g] + 0.001 * d * d
            w[g] -= rate * (m[g] / (1 - 0.9**k)) / (math.sqrt(v[g] / (1 - 0.999**k)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b -= rate * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(b + sum(w[g] * r[g] for g in grams(t) if g in r)))), abs=2e-3), i


# --- URL filters


def brute_decision(url, when, entries):
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::\d*)?([^?#]*)", url or "")
    host, path = (m[1].lower().rstrip("."), m[2]) if m else ("", "")
    active = []
    for (name, key), changes in entries.items():
        h, slash, rest = key.partition("/")
        if not host or not (host == h or host.endswith("." + h)) or not path.startswith(slash + rest):
            continue
        past = [adds for at, adds in sorted(changes) if when is not None and at <= when]
        if past and past[-1]:
            active.append(name)
    other = [n for n in active if n != "allow"]
    return len(other), min(other, default=None), "allow" in active


def test_url_filters_against_brute_force(spark):
    rng, base = random.Random(7), datetime(2024, 1, 1)
    keys = ["a.example", "b.a.example", "example", "c.example/ads/", "c.example/ads/deep/", "d.example"]
    entries = defaultdict(list)
    for _ in range(60):
        entries[rng.choice(["spam", "adult", "allow"]), rng.choice(keys)].append((base + timedelta(days=rng.randrange(400)), rng.random() < 0.6))
    entries = {k: [(at, max(a for t, a in v if t == at)) for at in {t for t, _ in v}] for k, v in entries.items()}
    urls = ["http://a.example/", "https://X.B.A.example:8080/p?q", "http://c.example/ads/x.html", "http://c.example/ads/deep/er/", "http://c.example/adsx", "http://nota.example2/", "http://u:p@d.example./", "bad url", "", None, "ftp://notd.example/ads/"]
    rows = [(i, rng.choice(urls), base + timedelta(days=rng.randrange(-30, 450), seconds=rng.randrange(2) * 43200), "mine") for i in range(300)]
    rows += [(900, "http://a.example/", None, "mine"), (901, None, base, "mine"), (1, *rows[1][1:])]
    for (_, _k), changes in list(entries.items())[:5]:
        rows.append((1000 + len(rows), "http://b.a.example/ads/", changes[0][0], "mine"))
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp, blocked string")
    table = spark.createDataFrame([(n, k, at, a) for (n, k), v in entries.items() for at, a in v] + [(None, "x", base, True), ("spam", None, base, True)], "list string, key string, at timestamp, adds boolean")
    got = url_filters.evaluate(captures, table).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, url, when, _ in rows:
        n, by, ok = brute_decision(url, when, entries)
        want[i, url, when, n, by, ok, n > 0 and not ok] += 1
    assert Counter((r.page_id, r.url, r.fetched, r.n_active, r.blocked_by, r.allowed, r.blocked) for r in got) == want
    assert any(r.blocked for r in got) and any(r.allowed for r in got)
    assert url_filters.evaluate(captures.where("false"), table).count() == 0
    assert {r.blocked for r in url_filters.evaluate(captures, table.where("false")).collect()} == {False}


# --- the pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = [a + b for a in ("ro", "mi", "ta", "lu", "se", "no") for b in ("ven", "dor", "lis", "kan", "pet")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, say(80), "en", f"s{min(i % 5, 2)}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(20)]  # copies
    rows += [(300, "junk junk " * 60, "en", "s1"), (301, "short", "en", "s1"), (302, None, "en", "s1")]
    rows += [(400, say(70) + ' token = "' + "0f" * 20 + '" ' + say(70), "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, after = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        after.append(now.collect())
    ids = [sorted(r.doc_id for r in x) for x in after]
    assert ids[0] == sorted([*range(120), *range(200, 220), 400])
    assert ids[1] == ids[2] == [*range(120), 400]
    secret = next(r for r in after[2] if r.doc_id == 400)
    assert "0f0f" not in secret.text and "<secret>" in secret.text and secret.n_chars == len(secret.text)
    assert set(ids[3]) == set(ids[2]) and len(ids[3]) > len(ids[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in out} == set(ids[3])
    assert sum(p.piece == 0 for p in out) == len(ids[3])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "secret scans", "mixing", "best-fit packing"]


def xxh(seed, *values):
    """XXH64 chained over strings, 32-bit ("i", n) and 64-bit ("q", n) numbers, signed."""
    h = seed
    for x in values:
        body = x.encode() if isinstance(x, str) else struct.pack("<" + x[0], x[1])
        h = xxhash.xxh64_intdigest(body, h)
    return h - (1 << 64) if h >> 63 else h


def brute_pipeline(rows, trusted, tokenizer):
    """Counter of (doc_id, piece, start, length, crc32) by plain loops over (doc_id, text, source)."""
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import classes, counts, simhash_of

    # quality rules: the buckets of words and pairs, two multinomials, the mean of log ratios
    def buckets(text):
        marks = [("i", xxh(42, w) >> 48) for w in (text or "").split()]
        return [m[1] & 0xFFFF for m in marks] + [(xxh(42, a, b) & 0x3FFFF) + 0x10000 for a, b in zip(marks, marks[1:], strict=False)]

    raw, good = Counter(), Counter()
    for i, text, _ in rows:
        raw.update(buckets(text))
        if i in trusted:
            good.update(buckets(text))
    n_raw, n_good = sum(raw.values()), sum(good.values())
    ratio = {b: round(1e6 * math.log((good[b] * n_raw / n_good + 5) / (raw[b] + 5))) for b in raw}
    kept = []
    for i, text, source in rows:
        c, found = counts(text), buckets(text)
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and sum(ratio[b] for b in found) >= -0.33e6 * len(found):
            kept.append((i, text, source))
    # near-dedup: the least id of every class
    root = classes([simhash_of(t) for _, t, _ in kept])
    least = {}
    for i, text, _ in kept:
        least[root[simhash_of(text)]] = min(i, least.get(root[simhash_of(text)], i))
    kept = [r for r in kept if least[root[simhash_of(r[1])]] == r[0]]
    # secrets: every finding, overlapping ones together
    clean = []
    for i, text, source in kept:
        hidden = bytearray(len(text))
        for rule in secret_scans.RULES:
            for m in rule.compiled().finditer(text):
                if len(m[rule.group]) >= rule.least:
                    hidden[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        clean.append((i, mask(text, hidden), source))
    # mixture: every source read in keyed permutations until its budget is used up
    tokens = Counter()
    for _, text, source in clean:
        tokens[source] += max(1, len(text.split()))
    weights = mixing.weights_at(tokens, mixing.find_exponent(tokens, None, 2.0))
    budget = max(n / weights[s] for s, n in tokens.items())
    read = []
    for s in tokens:
        epoch = at = 0
        while at < budget * weights[s] * (1 - 1e-12):
            mine = sorted((r for r in clean if r[2] == s), key=lambda r: xxh(42, ("i", 0), ("i", epoch), ("q", xxh(42, ("q", r[0]), r[1]))))  # noqa: B023
            for r in mine:
                if at < budget * weights[s] * (1 - 1e-12):
                    read.append(r)
                at += max(1, len(r[1].split()))
            epoch += 1
    # pieces
    library, out = Tokenizer.from_file(tokenizer), Counter()
    for i, text, _ in read:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(pairwise([0, *range(first, len(ids) + 1, 1024)])):
            out[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    return out


def mask(text, hidden):
    out = []
    for k, c in enumerate(text):
        if not hidden[k]:
            out.append(c)
        elif not k or not hidden[k - 1]:
            out.append("<secret>")
    return "".join(out)


def test_pipeline_against_brute_force(spark, tmp_path, tokenizer):
    rng = random.Random(21)
    words = [a + b for a in ("ro", "mi", "ta", "lu", "se", "no") for b in ("ven", "dor", "lis", "kan", "pet")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, say(rng.randrange(60, 2500 if i % 9 == 0 else 140)), f"s{min(i % 6, 2)}") for i in range(150)]
    rows += [(200 + i, rows[i][1] if i % 2 else rows[i][1].upper(), "s0") for i in range(30)]
    rows += [(300 + i, " ".join(f"junk{rng.randrange(40)}" for _ in range(90)), "s1") for i in range(20)]
    rows += [(400, say(40) + ' token = "' + "0f" * 20 + '" AKIA' + "B7" * 9 + " " + say(30), "s2"), (401, "", "s2"), (402, None, "s1"), (403, "same same " * 80, "s0")]
    trusted = {i for i in range(0, 150, 2)} | {400}
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(rows, trusted, tokenizer)
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == want
    ids = {k[0] for k in want}
    assert len(ids & set(range(150))) > 140 and 400 in ids and not ids & {*range(200, 330), 401, 402, 403} and max(want.values()) >= 2


CLASHES = ("tokens", "key", "row", "blob", "address", "cleaned", "hash", "id", "n_words", "kept", "_sum", "epoch", "fingerprint")


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    rng = random.Random(10)
    say = lambda n: " ".join(rng.choice("river stone bridge garden window letter morning evening paper table".split()) + str(rng.randrange(90)) for _ in range(n))
    rows = [(i, say(80), "en", f"s{i % 2}") for i in range(20)] + [(30, None, None, None), (31, "", "en", "s0"), (None, say(70), None, None), (32, say(60_000), "en", "s1")]
    rows += [rows[3], rows[3], (33, 'token = "' + "0f" * 20 + '" ' + say(60), "en", "s0")]
    full = [(*r, len(r[1] or ""), *[f"{c}{r[0]}" for c in CLASHES]) for r in rows]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame(full, kinds)
    spark.createDataFrame([(i, 1, 0) for i in (*range(20), 32, 33)] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, str(tmp_path)))
            assert now.columns == docs.columns, name
            for r in now.collect():
                assert [r[c] for c in CLASHES] == [f"{c}{r.doc_id}" for c in CLASHES], name
        if table is docs:
            ids = Counter(r.doc_id for r in now.collect())
            assert set(ids) - {None} == {*range(20), 32, 33}  # the short ones are gone
            assert not any("0f0f" in r.text for r in now.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.where("piece = 0").count() == now.count()

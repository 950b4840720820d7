"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.llm import fingerprints, lexical, minhash, mixing, negatives, packing, quality_rules, secret_scans, sharding, simhash, substring_dedup, toxicity, url_filters
from lettercrate.llm.common import documents, shared_dir, written

N_SHARDS = 8
TOXIC_FROM = 0.7


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a path with one version; a fresh ledger is filled and joined back."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = secret_scans.update_ledger(docs, shared_dir(spark))
    found = secret_scans.findings_by_path(docs, ledger)
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    base = [r.kind for r in secret_scans.BASE_RULES]
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secret_scans.as_text(of(*base)), 256).alias("base_sha256"),
        secret_scans.as_text(F.col("findings")).alias("spans"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(documents(spark, sf_dir), quality_rules.trusted_ids(labels))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: bytes. The map is saved as version 1 of a table and read back from it."""
    rows = sharding.with_slots(documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = rows.select("doc_id", "size", "text_crc32", "virtual_slot")
    maps = shared_dir(spark)
    sharding.save_map(spark, sharding.first_map(sharding.slot_sizes(rows), N_SHARDS), maps)
    out = sharding.assign(rows, sharding.load_map(spark, maps))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once at least, the rarest source twice at most."""
    rows = written(mixing.prepare(documents(spark, sf_dir)).select("doc_id", "source", "tokens", "key"))  # texts are read once
    return mixing.mix(rows).drop("key")


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir), always=True)


#: Captures and a dated list that follow from pages: a page's id sets when it was fetched; a host's least page id sets
#: which lists it is on, and when it was added, removed and added again.
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seconds = F.pmod(F.col("page_id") * 7919, F.lit(400)) * 86400 + F.pmod(F.col("page_id") * 104729, F.lit(86400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).alias("fetched"))


def list_entries(rows: DataFrame) -> DataFrame:
    hosts = rows.select("page_id", url_filters.host_of(F.col("url")).alias("host")).where("host != ''")
    # the host without a first label such as www, m or blog
    hosts = hosts.withColumn("host", F.regexp_replace("host", r"^(www|m|blog)\.", "")).groupBy("host").agg(F.min("page_id").alias("k"))
    day = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("k") * 31, F.lit(300)) * 86400)
    later = lambda days: F.timestamp_seconds(F.unix_seconds(day) + days * 86400)

    def entry(name: str, key, at, adds: bool, where):
        return F.when(where, F.struct(F.lit(name).alias("list"), key.alias("key"), at.alias("at"), F.lit(adds).alias("adds")))

    host, k = F.col("host"), F.col("k")
    spam = host.rlike("casino|bets|pills")
    found = F.array_compact(F.array(
        entry("spam", host, day, True, spam),
        entry("adult", host, day, True, k % 3 == 0),
        entry("adult", host, later(F.lit(40)), False, k % 3 == 0),
        entry("adult", host, later(F.lit(90)), True, k % 6 == 0),
        entry("paths", F.concat(host, F.lit("/en/")), day, True, k % 5 == 0),
        entry("allow", host, later(F.lit(20)), True, k % 7 == 0),
    ))
    return hosts.select(F.explode(found).alias("entry")).select("entry.*")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir)
    return url_filters.evaluate(rows, list_entries(rows))


OP7_SQL = r"""
WITH c AS (
  SELECT page_id, url, make_timestamp(1000000 * (1704067200 + (page_id * 7919 % 400) * 86400 + page_id * 104729 % 86400)) AS fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS host, min(page_id) AS k FROM c WHERE host <> '' GROUP BY 1),
d AS (SELECT host, k, 1704067200 + (k * 31 % 300) * 86400 AS s FROM h),
e AS (
  SELECT 'spam' AS list, host, '' AS prefix, s AS f, NULL AS t FROM d WHERE regexp_matches(host, 'casino|bets|pills')
  UNION ALL SELECT 'adult', host, '', s, s + 40 * 86400 FROM d WHERE k % 3 = 0
  UNION ALL SELECT 'adult', host, '', s + 90 * 86400, NULL FROM d WHERE k % 6 = 0
  UNION ALL SELECT 'paths', host, '/en/', s, NULL FROM d WHERE k % 5 = 0
  UNION ALL SELECT 'allow', host, '', s + 20 * 86400, NULL FROM d WHERE k % 7 = 0),
a AS (
  SELECT c.page_id, e.list FROM c JOIN e
    ON (c.host = e.host OR ends_with(c.host, '.' || e.host)) AND starts_with(c.path, e.prefix)
    AND epoch(c.fetched) >= e.f AND (e.t IS NULL OR epoch(c.fetched) < e.t)),
g AS (
  SELECT page_id, count(*) FILTER (WHERE list <> 'allow') AS n, min(list) FILTER (WHERE list <> 'allow') AS b,
    count(*) FILTER (WHERE list = 'allow') > 0 AS ok FROM a GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, c.host, CAST(coalesce(g.n, 0) AS BIGINT) AS n_active, g.b AS blocked_by,
  coalesce(g.ok, false) AS allowed, coalesce(g.n, 0) > 0 AND NOT coalesce(g.ok, false) AS blocked
FROM c LEFT JOIN g ON c.page_id = g.page_id
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), pair_words=substring_dedup.PAIR_WORDS, least_whole=2)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


#: All pairs that share a shingle, counted; equal sets are one node.
OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM w),
g AS (SELECT x, min(doc_id) AS node, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
u AS (SELECT node, n, unnest(x) AS shingle FROM g),
l AS (
  SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
r AS (SELECT node, node AS other FROM g UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN g ON s.x = g.x LEFT JOIN c ON g.node = c.node
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
a AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
u AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (
  SELECT p.doc_id, p.term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))) AS s
  FROM p JOIN f USING (term), a),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM i JOIN x USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_secret_scans, op2_best_fit_packing, op3_quality_rules, op4_virtual_slots, op5_temperature_mixing,
            op6_closed_syncmers, op7_url_filters, op8_toxicity, op9_simhash, op10_substring_dedup, op11_minhash, op12_lexical_search, op13_hard_negatives,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op11_minhash": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_hard_negatives": OP13_SQL}

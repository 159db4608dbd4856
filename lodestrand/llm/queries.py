"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import byte_bpe, collisions, divergence, edits, main_text, packing, pivots, quality, revisits, sharding, simhash, toxicity, turns
from lodestrand.llm.samples import remainder
from lodestrand.storage import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from pages: a full response and three not-modified revisits of each, by a fixed rule."""
    start, span = 1704067200, 2592000
    responded = F.lit(start) + F.pmod(F.col("page_id") * 7919, F.lit(span))
    etag = F.when(F.col("page_id") % 10 != 9, F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    r = F.col("r")
    pages = pages.select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("long").alias("length"), etag.alias("tag"), responded.alias("responded"))
    rows = pages.withColumn("r", F.explode(F.array(*(F.lit(i) for i in range(4)))))
    captured = F.when(r == 0, F.col("responded")).otherwise(F.lit(start) + F.pmod(F.col("page_id") * 104729 + r * 611953, F.lit(span)))
    joiner = F.when(F.col("url").contains("?"), "&").otherwise("?")
    url = F.when(r == 2, F.concat("url", F.lit("#r2"))).when(r == 3, F.concat("url", joiner, F.lit("utm_campaign=r3"))).otherwise(F.col("url"))
    stale = F.when((F.col("page_id") + r) % 6 == 0, '"stale"').when(r == 2, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    modified = F.when((r == 0) | (F.col("page_id") % 4 != 0), (F.col("responded") - 3600).cast("string"))
    response = F.map_from_arrays(F.array(F.lit("cache-control"), F.lit("content-length"), F.lit("content-type"), F.lit("date")), F.array(F.lit("max-age=60"), F.col("length").cast("string"), F.lit("text/html"), F.col("captured_at").cast("string")))
    revisit = F.map_from_arrays(F.array(F.lit("cache-control"), F.lit("content-length"), F.lit("date"), F.lit("server")), F.array(F.concat(F.lit("max-age="), (r * 100).cast("string")), F.lit("0"), F.col("captured_at").cast("string"), F.lit("edge")))
    return rows.withColumn("captured_at", captured).select(
        (F.col("page_id") * 4 + r).alias("record_id"), url.alias("url"), "captured_at", F.when(r == 0, "response").otherwise("revisit").alias("kind"),
        F.when(r == 0, F.col("tag")).otherwise(stale).alias("etag"), modified.alias("last_modified"),
        F.when(r == 0, F.col("digest")).alias("payload_digest"), F.when(r == 0, F.col("length")).alias("payload_length"), F.when(r == 0, response).otherwise(revisit).alias("headers"),
    )


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_text(F.col("headers")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, most=3)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def edited(trees: DataFrame, batch: int) -> DataFrame:
    """Three edits of each document by a fixed rule: a replacement, an insertion and a removal."""
    chars = F.aggregate("leaves", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(3 * batch + i)), chars + 1)
    edit = lambda i, removed, inserted: F.struct(at(i).alias("position"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return trees.withColumn("edits", F.array(edit(0, 17, F.concat(F.lit(" edit "), F.col("doc_id").cast("string"))), edit(1, 0, F.lit("\n\nIn addition, 3 more words.")), edit(2, 60, F.lit(""))))


def op9_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of edits: the second reads the trees that the first left, and encodes only what it touches."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = edits.build_trees(table(spark, sf_dir, "documents"), ranks, pattern)
    once = staged(edits.apply_edits(edited(trees, 0), ranks, pattern), "zstd")  # whole texts
    return edits.apply_edits(edited(once, 1), ranks, pattern).drop("leaves", "counts")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_packing": op2_packing,
    "op3_pivots": op3_pivots,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_collisions": op5_collisions,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_edits": op9_edits,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_turns": op12_turns,
    "op13_main_text": op13_main_text,
}

_URL = "regexp_replace(trim(url), '#.*$', '')"
_PART = lambda n: f"regexp_extract({_URL}, '{revisits.URL_PARTS}', {n})"
_HOST = f"regexp_replace(regexp_replace(lower({_PART(1)}), '^www\\.', ''), ':(80|443)$', '')"
_PATH = f"coalesce(nullif(regexp_replace({_PART(2)}, '/+$', ''), ''), '/')"
_QUERY = f"array_to_string(list_sort(list_filter(string_split({_PART(3)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{revisits.IGNORED_PARAMETER}'))), '&')"

ORACLE: dict[str, str] = {
    "op1_revisits": f"""WITH p AS (SELECT page_id, url, md5(html) AS digest, length(html)::BIGINT AS length, CASE WHEN page_id % 10 <> 9 THEN '"' || md5(html) || '"' END AS tag, 1704067200 + (page_id * 7919) % 2592000 AS responded FROM pages),
    r AS (SELECT *, unnest([0, 1, 2, 3]) AS r FROM p), u AS (SELECT *, page_id * 4 + r AS record_id, CASE WHEN r = 0 THEN responded ELSE 1704067200 + (page_id * 104729 + r * 611953) % 2592000 END AS captured_at,
    CASE WHEN r = 0 THEN tag WHEN (page_id + r) % 6 = 0 THEN '"stale"' WHEN r = 2 THEN 'W/' || tag ELSE tag END AS etag, CASE WHEN r = 0 OR page_id % 4 <> 0 THEN (responded - 3600)::VARCHAR END AS modified,
    CASE r WHEN 2 THEN url || '#r2' WHEN 3 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=r3' ELSE url END AS told FROM r),
    k AS (SELECT * EXCLUDE (url, told), CASE WHEN regexp_matches({_URL}, '{revisits.URL_PARTS}') THEN {_HOST} || {_PATH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END ELSE trim(url) END AS canonical_url FROM (SELECT * EXCLUDE (url), told AS url FROM u)),
    j AS (SELECT v.record_id, v.canonical_url, v.captured_at, v.r, v.etag, v.modified, b.record_id AS response_id, b.etag AS base_etag, b.modified AS base_modified, b.digest, b.length FROM k v LEFT JOIN (SELECT * FROM k WHERE r = 0) b
    ON v.canonical_url = b.canonical_url AND b.captured_at < v.captured_at WHERE v.r > 0 QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY b.captured_at DESC, b.record_id DESC) = 1),
    s AS (SELECT *, CASE WHEN etag IS NOT NULL AND base_etag IS NOT NULL THEN 'etag' WHEN modified IS NOT NULL AND base_modified IS NOT NULL THEN 'last_modified' END AS validator FROM j),
    t AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN validator IS NULL THEN 'unchecked' WHEN CASE WHEN validator = 'etag' THEN replace(etag, 'W/', '') = base_etag ELSE modified = base_modified END THEN 'resolved' ELSE 'mismatch' END AS status FROM s)
    SELECT record_id, canonical_url, captured_at, status, validator, response_id, CASE WHEN status = 'resolved' THEN digest END AS payload_digest, CASE WHEN status = 'resolved' THEN length END AS payload_length,
    CASE WHEN status = 'resolved' THEN 'cache-control=max-age=' || (r * 100) || '; content-length=' || length || '; content-type=text/html; date=' || captured_at END AS headers FROM t""",
    "op3_pivots": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT n) AS docs FROM (SELECT n, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
    k AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM t GROUP BY ALL HAVING sum(docs) >= 30), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c) AS n FROM k GROUP BY lang),
    g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(t.c) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source)),
    p AS (SELECT g.lang, g.source, k.term, coalesce(t.c, 0) AS c, 1 + 1000000000 * (coalesce(t.c, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000 * (k.c + 5) // (l.n + 5 * l.v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
}

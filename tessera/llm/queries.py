"""The queries ``opN_<name>`` and their SQL, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, conversation_repair, exact_dedup, hard_negatives, html_main, language_id, license_scan, mixing, packing, simhash, toxicity, transport_stream, url_filter
from tessera.llm.common import LOWER, UPPER, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_columns(table(spark, sf_dir, "documents"))


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op3_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op8_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op11_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("id") % 50 == 0)


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


# Parts of the queries above that SQL can express, so that they can be compared with it.


def llm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 reads back from its streams."""
    return op1_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op4, and its verdicts where a rule judged."""
    found = op4_url_language_models(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op5."""
    return op5_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def llm_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and phrases of op10."""
    return op10_license_templates(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm_conversation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and faults of op13."""
    return op13_repair_conversations(spark, sf_dir).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")


def llm_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether op11 packs every document whole, gapless, and in sequences that need no padding: sums over its pieces, which must agree with each other."""
    pieces = op11_pack_mixture(spark, sf_dir)
    # a piece counts for its document and for its sequence in one pass, since packing is what costs
    side = lambda document, key, start: F.struct(F.lit(document).alias("document"), F.col(key).cast("long").alias("key"), F.col("length").cast("long").alias("length"), (F.col(start) + F.col("length")).cast("long").alias("end"), F.col("doc_tokens").alias("of"))
    sides = pieces.select(F.explode(F.array(side(True, "doc_id", "start"), side(False, "sequence_id", "offset"))).alias("x")).select("x.*")
    sums = sides.groupBy("document", "key").agg(F.sum("length").alias("n"), F.max("of").alias("of"), F.max("end").alias("end"))
    size = (F.col("n") == F.col("end")) & ((F.col("n") == 1024) | (F.bit_count("n") == 1)) & (F.col("n") <= 1024)
    whole = F.bool_and(F.when(F.col("document"), (F.col("n") == F.col("of")) & (F.col("end") == F.col("of"))))
    return sums.agg(F.count_if("document").alias("documents"), whole.alias("whole"), F.bool_and(F.when(~F.col("document"), size)).alias("full"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_transport_stream,
        op2_toxic_spans,
        op3_bpe_backtracking,
        op4_url_language_models,
        op5_mix_sources,
        op6_exact_dedup,
        op7_main_text,
        op8_simhash_grid,
        op9_language_ppm,
        op10_license_templates,
        op11_pack_mixture,
        op12_hard_negatives,
        op13_repair_conversations,
        llm_payloads,
        llm_url_rules,
        llm_mix_targets,
        llm_license_phrases,
        llm_conversation_faults,
        llm_packed_tokens,
    )
}

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

ORACLES = {
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
        p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
        FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps WINDOW w AS (PARTITION BY a, p ORDER BY s DESC, b) QUALIFY row_number() OVER w <= 3""",
    "llm_packed_tokens": "SELECT count(DISTINCT doc_id) AS documents, true AS whole, true AS full FROM documents",
    "llm_conversation_faults": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM conversations),
        k AS (SELECT *, xor(list_reduce(b, lambda a, x: list_reduce(range(8), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END, xor(a, x)), 4294967295), 4294967295) % 20 AS k FROM c),
        d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
            lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) || substr(role, 1, 1) AS pair FROM d),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "llm_payloads": """
        WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT *, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS pad FROM n)
        SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(b || unhex(repeat('00', pad))) AS payload_sha256 FROM p""",
    "llm_url_rules": f"""
        WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
        k AS (SELECT *, CASE WHEN {_FITS.format(h="example.net", p="/en/")} THEN 'example.net/en/' WHEN {_FITS.format(h="example.com", p="/de/")} THEN 'example.com/de/' WHEN {_FITS.format(h="org", p="/fr/")} THEN 'org/fr/' WHEN {_FITS.format(h="net", p="/")} THEN 'net/' END AS rule FROM h)
        SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM k""",
    "llm_mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS sz, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1] AS w FROM s), o AS (SELECT *, sum(sz) OVER () - coalesce(sum(3 * sz) OVER (ORDER BY 3 * sz / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (ORDER BY 3 * sz / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, row_number() OVER (ORDER BY 3 * sz / w, k) AS place FROM w),
        u AS (SELECT arg_min(CAST(left_ AS DOUBLE) / CAST(w_left AS DOUBLE), place) AS level FROM o WHERE CAST(left_ AS DOUBLE) / CAST(w_left AS DOUBLE) <= 3 * sz / CAST(w AS DOUBLE))
        SELECT doc_id, size, sz AS source_size, round(least(3.0 * sz, coalesce(level, 0) * CAST(w AS DOUBLE)), 3)::DOUBLE AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, u""",
    "llm_license_phrases": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS c, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS r FROM w)
        SELECT doc_id, n AS n_words, len(c) + len(g) + len(r) AS n_base, list_min(list_concat(c, g, r)) - 1 AS first_word, list_max(list_concat(c, g, r)) - 1 AS last_word,
        concat_ws(',', CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END) AS base_labels FROM p""",
}

"""Accounting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import reports as R
from tessera.operators import usage as U
from tessera.plans.base import query, table

_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.length("html").cast("long").alias("size"))


@query(
    "WITH t AS (SELECT role, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars FROM conversations), r AS (SELECT CASE WHEN grouping(role) = 1 THEN 'combined' ELSE role END AS role, count(*) AS operations, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars FROM t GROUP BY ROLLUP (role))"
    " SELECT *, round(tokens / greatest(operations, 1), 2) AS tokens_per_operation, round(chars / greatest(operations, 1), 2) AS chars_per_operation FROM r"
)
def usage_rollup(spark, sf):
    c = table(spark, sf, "conversations").select("role", T.estimated_tokens("text").alias("tokens"), F.length("text").cast("long").alias("chars"))
    return R.usage_rollup(c, "role", ["tokens", "chars"])


@query(
    "SELECT source, round(coalesce(sum(CASE WHEN toxic = 0 THEN greatest(0.0, least(1.0, quality * 1.5 - 0.25)) * (0.75 + (l.doc_id % 3) * 0.25) ELSE 0 END) / nullif(sum(CASE WHEN toxic = 0 THEN 0.75 + (l.doc_id % 3) * 0.25 ELSE 0 END), 0), 0), 6)::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"
)
def weighted_requirement_score(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return R.weighted_score(j, ["source"], F.col("quality") * 1.5 - 0.25, 0.75 + (F.col("doc_id") % 3) * 0.25, F.col("toxic") == 0)


@query(
    """WITH t AS (SELECT role, conv_id % 3 + 1 AS requests, ceil(length(text) / 4)::BIGINT AS i, (turn * 7 + 3)::BIGINT AS o, (conv_id % 5) * 100 AS ms, turn FROM conversations), s AS (SELECT role, count(*) AS operations, sum(requests)::BIGINT AS requests, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(ms)::BIGINT AS ms FROM t GROUP BY role),
    d AS (SELECT role, 'turn_' || (turn % 3) AS k, sum(i) AS n FROM t GROUP BY ALL UNION ALL SELECT role, 'odd', sum(o) FROM t WHERE turn % 2 = 1 GROUP BY role), m AS (SELECT role, string_agg(k || '=' || n, ';' ORDER BY k) AS details FROM d GROUP BY role)
    SELECT role, operations, requests, input_tokens, output_tokens, details, round((input_tokens + output_tokens) / requests, 4) AS tokens_per_request, CASE WHEN ms > 0 THEN round((input_tokens + output_tokens) * 1000 / ms, 4) END AS tokens_per_second FROM s JOIN m USING (role)"""
)
def merged_usage(spark, sf):
    """Usage of roles with nested counts, merged in two parts and the parts merged."""
    c = table(spark, sf, "conversations")
    tokens, out = T.estimated_tokens("text"), F.col("turn") * 7 + 3
    odd = F.when(F.col("turn") % 2 == 1, F.create_map(F.lit("odd"), out))
    rows = c.select(
        "role", "conv_id", (F.col("conv_id") % 3 + 1).alias("requests"), tokens.alias("input_tokens"), out.alias("output_tokens"), (F.col("conv_id") % 5 * 100).alias("total_duration_ms"), F.lit(0).alias("response_duration_ms"),
        U.added(F.create_map(F.concat(F.lit("turn_"), (F.col("turn") % 3).cast("string")), tokens), odd).alias("details"),
    )
    measures = ["requests", "input_tokens", "output_tokens", "response_duration_ms", "total_duration_ms"]
    parts = [U.merge_usage(rows.filter(F.col("conv_id") % 2 == k), ["role"], measures, "details") for k in (0, 1)]
    made = U.with_ratios(U.merge_merged(parts[0].unionByName(parts[1]), ["role"], measures, "details"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ";")
    return made.select("role", "operations", "requests", "input_tokens", "output_tokens", shown.alias("details"), "tokens_per_request", "tokens_per_second")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS total FROM events GROUP BY user_id")
def status_counts(spark, sf):
    return R.status_counts(table(spark, sf, "events"), "event_type", ["click", "error", "purchase"], ["user_id"])


@query(
    "SELECT o_custkey, CASE WHEN NOT bool_or(o_orderstatus = 'F') THEN 'empty_shell' WHEN bool_and(o_orderstatus = 'F') AND NOT bool_or(o_totalprice > 400000) THEN 'complete' ELSE 'imperfect' END AS quality FROM orders GROUP BY o_custkey"
)
def draft_quality(spark, sf):
    return R.draft_quality(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_totalprice") > 400_000)


@query(
    f"WITH p AS (SELECT string_split({_PATH}, '/') AS x, length(html) AS size FROM pages) SELECT CASE WHEN len(x) > 1 THEN x[1] ELSE '' END AS stage, CASE WHEN len(x) > 2 THEN x[2] ELSE '' END AS strategy, CASE WHEN len(x) > 3 THEN x[3] ELSE '' END AS model, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY ALL"
)
def artifact_index(spark, sf):
    return R.artifact_index(_paths(spark, sf), "path", "size")


@query(
    f"WITH p AS (SELECT string_split({_PATH}, '/') AS x FROM pages), d AS (SELECT array_to_string(x[1:k], '/') AS directory FROM (SELECT x, unnest(range(1, greatest(len(x), 2))) AS k FROM p WHERE len(x) > 1)) SELECT directory, count(*) AS files, CAST(len(string_split(directory, '/')) AS BIGINT) AS depth FROM d GROUP BY directory"
)
def path_closure(spark, sf):
    return R.path_closure(_paths(spark, sf), "path")


@query("SELECT DISTINCT source, event_type FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT event_type FROM events)")
def run_matrix(spark, sf):
    return R.run_matrix(table(spark, sf, "documents").select("source").distinct(), table(spark, sf, "events").select("event_type").distinct())


@query(
    "WITH k AS (SELECT DISTINCT l_partkey AS kind, l_suppkey AS unit FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_partkey AS kind, l_suppkey AS unit FROM lineitem) SELECT p.kind, p.unit, CASE WHEN k.unit IS NOT NULL THEN 'compatible' WHEN p.kind IN (SELECT kind FROM k) THEN 'incompatible' ELSE 'unknown' END AS status FROM p LEFT JOIN k ON p.kind = k.kind AND p.unit = k.unit"
)
def quantity_pair_status(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("kind"), F.col("l_suppkey").alias("unit"), "l_returnflag")
    return R.pair_status(items.select("kind", "unit").distinct(), items.filter("l_returnflag = 'R'"), "kind", "unit").select("kind", "unit", "status")


@query(
    "WITH k AS (SELECT DISTINCT l_orderkey, l_partkey AS kind, l_suppkey AS unit FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT l_orderkey, count(*) AS n_pairs, min(kind) AS kind, min(unit) AS unit FROM k GROUP BY l_orderkey) SELECT l_orderkey, n_pairs, CASE WHEN n_pairs = 1 THEN kind END AS kind, CASE WHEN n_pairs = 1 THEN unit END AS unit FROM n"
)
def quantity_pair_resolution(spark, sf):
    items = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("kind"), F.col("l_suppkey").alias("unit"))
    return R.choose_pairs(items, ["l_orderkey"], "kind", "unit")


@query(
    "WITH c AS (SELECT d.doc_id, d.source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, source, CASE WHEN quality IS NULL THEN 10000 WHEN quality = 1 THEN 1 ELSE 2 END AS rank, coalesce(CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' END, 'unlabelled') AS summary FROM c"
)
def inventory(spark, sf):
    labels = table(spark, sf, "labels")
    ranks = labels.select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(2).alias("rank"))
    notes = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("summary"))
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(ranks, "doc_id", "left").join(notes, "doc_id", "left").select("doc_id", "source", F.coalesce("rank", F.lit(10_000)).alias("rank"), F.coalesce("summary", F.lit("unlabelled")).alias("summary"))


@query("SELECT lang, count(*) FILTER (toxic = 1) AS rejected_evidence, count(*) FILTER (toxic = 0 AND quality = 1) AS portable_evidence, count(*) FILTER (toxic = 0 AND quality = 0) AS contextual_evidence FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def category_distribution(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    r = F.when(F.col("toxic") == 1, "rejected_evidence").when(F.col("quality") == 1, "portable_evidence").otherwise("contextual_evidence")
    p = j.withColumn("route", r).groupBy("lang").pivot("route", ["rejected_evidence", "portable_evidence", "contextual_evidence"]).count()
    return p.na.fill(0)

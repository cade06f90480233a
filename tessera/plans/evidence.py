"""Evidence queries over documents, labels, line items and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence as E
from tessera.plans.base import query, table

_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[‐-―]', '-', 'g'), '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH k AS (SELECT doc_id, {_NORM} AS key, CAST(substr(source, 4) AS INTEGER) AS r, length(text) AS n FROM documents), w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY CASE WHEN key = '' THEN 'id' || doc_id ELSE 'k' || key END ORDER BY r, -n, doc_id) AS representative FROM k) SELECT doc_id, representative, doc_id = representative AS kept FROM w"""
)
def exact_dedup_representative(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr("cast(substr(source, 4) as int)").alias("r"))
    return E.representatives(docs, [T.normalise_evidence("text")], "doc_id", F.col("r"), F.col("text"), F.col("doc_id"))


@query()
def fuzzy_dedup_components(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", "text", F.lit("benchmark").alias("kind"))
    more = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.regexp_replace("text", r"\bthe\b", "a").alias("text"), F.lit("changed").alias("kind"))
    return E.components(E.fuzzy_links(items.union(more), "item_id", "text", "kind"))


@query()
def fuzzy_groups(spark, sf):
    """Groups of benchmark passages and their changed forms, with the largest similarity in each."""
    items = table(spark, sf, "benchmark").select("item_id", "text", F.lit("benchmark").alias("kind"))
    more = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.regexp_replace("text", r"\bthe\b", "a").alias("text"), F.lit("changed").alias("kind"))
    return E.fuzzy_groups(E.fuzzy_links(items.union(more), "item_id", "text", "kind", least=0.8))


_ASSESS = "CASE WHEN quality = 1 THEN 'yes' ELSE 'partial' END"


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'no' WHEN quality = 1 THEN 'yes' ELSE 'partial' END AS g, {_ASSESS} AS q, CASE WHEN doc_id % 11 = 0 THEN 'high' ELSE 'low' END AS u, CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'yes' END AS s FROM labels)
    SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'contextual_evidence' WHEN g = 'no' THEN 'rejected_evidence' WHEN u = 'high' THEN 'contextual_evidence' WHEN g = 'yes' AND q = 'yes' THEN 'portable_evidence' ELSE 'contextual_evidence' END AS route,
    CASE WHEN a.doc_id IS NULL THEN 'conservative_contextual_default' WHEN g = 'no' THEN 'critic_not_grounded' WHEN u = 'high' THEN 'borderline_or_ambiguous' WHEN g = 'yes' AND q = 'yes' THEN 'portable_grounded_evidence' ELSE 'conservative_contextual_default' END AS reason
    FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""
)
def evidence_routing(spark, sf):
    yes = F.when(F.col("quality") == 1, "yes").otherwise("partial")
    a = table(spark, sf, "labels").select(
        F.col("doc_id").alias("candidate_id"), F.lit(0).alias("position"), F.when(F.col("toxic") == 1, "no").otherwise(yes).alias("groundedness"), yes.alias("self_containedness"),
        F.when(F.col("doc_id") % 5 == 0, "partial").otherwise("yes").alias("scope_clarity"), yes.alias("portability"), yes.alias("semantic_interpretability"), F.lit("low").alias("environment_dependence"),
        yes.alias("specificity"), F.when(F.col("doc_id") % 11 == 0, "high").otherwise("low").alias("uncertainty"),
    )
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"))
    return E.route_candidates(docs, a).withColumnRenamed("candidate_id", "doc_id")


@query(
    """WITH r AS (SELECT l_orderkey AS k, l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + CAST(l_linenumber AS BIGINT) AS e FROM lineitem)
    SELECT a.id, count(DISTINCT b.id) AS n_near, min(b.id) AS first_near FROM r a JOIN r b ON a.k = b.k AND a.id <> b.id AND ((a.s <= b.e AND b.s <= a.e) OR abs(a.s - b.s) <= 2 OR abs(a.e - b.e) <= 2) GROUP BY a.id"""
)
def span_overlap_window(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("e"))
    return E.window_neighbours(r, "l_orderkey", "id", "s", "e", 2).groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("first_near"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) - 1 AS n_near FROM events")
def band_context(spark, sf):
    return E.band_counts(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 500)


@query(
    r"""WITH h AS (SELECT DISTINCT 'req' || (item_id % 20) AS requirement_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM benchmark), c AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS term FROM documents),
    s AS (SELECT requirement_id, doc_id, count(*) AS score FROM c JOIN h ON c.term = h.term GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, doc_id) AS INTEGER) AS position FROM s) SELECT * FROM k WHERE position <= 5"""
)
def requirement_packets(spark, sf):
    req = table(spark, sf, "benchmark").groupBy(F.concat(F.lit("req"), (F.col("item_id") % 20).cast("string")).alias("requirement_id")).agg(F.collect_list("text").alias("hints"))
    return E.score_requirements(table(spark, sf, "documents").select("doc_id", "text"), req, "text", ["doc_id"])


@query(
    f"""WITH c AS (SELECT doc_id, source, {_NORM} AS t, CASE WHEN toxic = 1 THEN 'rejected_evidence' WHEN quality = 1 THEN 'portable_evidence' ELSE 'contextual_evidence' END AS route FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY route, t ORDER BY doc_id) AS k FROM c) SELECT route, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum FROM k WHERE k = 1 OR route = 'rejected_evidence' GROUP BY route"""
)
def merged_contexts(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    r = F.when(F.col("toxic") == 1, "rejected_evidence").when(F.col("quality") == 1, "portable_evidence").otherwise("contextual_evidence")
    c = joined.select(F.col("doc_id").alias("candidate_id"), F.lit("f").alias("file_path"), F.lit(0).alias("start_idx"), F.lit(0).alias("end_idx"), F.col("text").alias("evidence_text"), r.alias("route"))
    return E.merge_contexts(c).groupBy("route").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("checksum"))


@query(
    rf"""WITH b AS (SELECT item_id, {_NORM} AS e FROM benchmark), d AS (SELECT doc_id, {_NORM} AS c FROM documents) SELECT doc_id, item_id FROM d JOIN b ON e <> '' AND contains(c, e)"""
)
def supported_evidence(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("evidence"))
    return E.find_passages(table(spark, sf, "documents").select("doc_id", "text"), b, "doc_id", "text", "item_id", "evidence")


@query(
    r"""SELECT conv_id, turn, CASE WHEN role = 'user' AND (contains(lower(text), 'acquisition') OR contains(lower(text), 'processing') OR contains(lower(text), 'experiment')) THEN 2 ELSE 0 END AS points, 'ev:' || substr(sha1(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text)), 1, 16) AS evidence_id FROM conversations"""
)
def class_hint_scores(spark, sf):
    c = table(spark, sf, "conversations")
    target = F.when(F.col("role") == "user", "DataGeneratingActivity").otherwise("EvaluatedEntity")
    return c.select("conv_id", "turn", E.class_points(target, F.lit("other_signal"), F.lit("value"), F.lower("text")).alias("points"), T.evidence_id("conv_id", "turn", "role", "text").alias("evidence_id"))


@query("SELECT source, lang, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) // 6 AS bucket, doc_id FROM documents")
def projection_buckets(spark, sf):
    return E.buckets(table(spark, sf, "documents").select("doc_id", "source", "lang"), [F.col("source"), F.col("lang")], F.col("doc_id")).select("source", "lang", "bucket", "doc_id")

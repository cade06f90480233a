"""Queries over what is chosen, in which order, and how much of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import selection as S
from tessera.plans.base import query, table
from tessera.plans.overview import _GROUP, _SUMMARY, _summaries
from tessera.plans.search import _EDGES, _NODES, edges, nodes


@query(
    r"""WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
    SELECT source, doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10))[1:80], lambda s: CASE WHEN length(s) <= 500 THEN s ELSE regexp_replace(substr(s, 1, 497), ' +$', '') || '...' END), chr(10))) AS preview FROM r WHERE k <= 16"""
)
def top_file_previews(spark, sf):
    files = S.top_files(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "doc_id")
    return files.select("source", "doc_id", F.sha2(F.array_join(S.preview(F.col("text")), "\n"), 256).alias("preview"))


@query(
    """WITH v AS (SELECT item_id, v, i FROM (SELECT item_id, string_split(text, ' ') AS l FROM benchmark), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i), LATERAL (SELECT trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS v)),
    f AS (SELECT item_id, v, min(i) OVER (PARTITION BY item_id, lower(v)) = i AS first, i FROM v WHERE v <> ''), k AS (SELECT item_id, v, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f WHERE first)
    SELECT item_id, string_agg(v, '|' ORDER BY i) AS kept FROM k WHERE k <= 8 GROUP BY item_id"""
)
def compact_values(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(S.compact_distinct(F.split("text", " "), 8), "|").alias("kept"))


_RANKED = ("view", "click", "purchase", "signup", "error")


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), s AS (SELECT user_id, list(event_type ORDER BY k) AS src FROM e WHERE k <= 1 + user_id % 4 GROUP BY user_id), r AS (SELECT *, ['view', 'click', 'purchase', 'signup'] AS ranked FROM s),
    n AS (SELECT *, list_filter(src, lambda x: list_contains(ranked, x)) AS known FROM r) SELECT user_id, known = ranked[1:len(known)] AS valid, list_sort(list_distinct(src)) = list_sort(ranked) AS same FROM n"""
)
def overview_still_valid(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    first = table(spark, sf, "events").withColumn("k", k).filter(F.col("k") <= 1 + F.col("user_id") % 4)
    sources = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]).alias("src"))
    ranked = F.array(*map(F.lit, _RANKED[:4]))
    return sources.select("user_id", S.still_valid(F.col("src"), ranked).alias("valid"), S.same_set(F.col("src"), ranked).alias("same"))


@query(
    """WITH n AS (SELECT c_nationkey AS package, 'c' || c_custkey AS node_id, 'f' || (c_custkey % 10) AS file_path FROM customer), e AS (SELECT c_nationkey AS package, c_custkey AS position, 'c' || c_custkey AS source, c_mktsegment AS relation, 'c' || (c_custkey * 7 % 150) AS target FROM customer),
    h AS (SELECT DISTINCT e.* FROM e JOIN n ON e.package = n.package AND n.file_path = 'f3' AND n.node_id IN (e.source, e.target)), k AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY position) AS k FROM h) SELECT package, 'f3' AS file_path, source, relation, target FROM k WHERE k <= 4"""
)
def neighbourhood_edges(spark, sf):
    c = table(spark, sf, "customer")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    own = c.select(F.col("c_nationkey").alias("package"), name(F.col("c_custkey")).alias("node_id"), F.concat(F.lit("f"), (F.col("c_custkey") % 10).cast("string")).alias("file_path"))
    links = c.select(F.col("c_nationkey").alias("package"), F.col("c_custkey").alias("position"), name(F.col("c_custkey")).alias("source"), F.col("c_mktsegment").alias("relation"), name(F.col("c_custkey") * 7 % 150).alias("target"))
    return S.neighbourhood(links, own, own.filter("file_path = 'f3'").select("package", "file_path").distinct())


@query(
    """WITH d AS (SELECT '/f/' || o_orderkey AS pointer, o_orderstatus AS st, ['q' || (o_custkey % 500), 'q' || (o_orderkey % 500)] AS q FROM orders), r AS (SELECT 'q' || (p_partkey % 500) AS query_id, p_partkey AS position, 'u' || p_size AS uri FROM part),
    a AS (SELECT pointer, st, i, q[i] AS query_id FROM d, LATERAL (SELECT unnest([1, 2]) AS i)), f AS (SELECT pointer, st, uri, min(struct_pack(a := i, b := position)) AS first FROM a JOIN r USING (query_id) GROUP BY ALL)
    SELECT pointer, CASE st WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS "order", uri, CAST(row_number() OVER (PARTITION BY pointer ORDER BY first, uri) AS INTEGER) AS place FROM f"""
)
def grounding_candidates(spark, sf):
    name = lambda c: F.concat(F.lit("q"), (F.col(c) % 500).cast("string"))
    field = F.when(F.col("o_orderstatus") == "F", "has_quantity_type").when(F.col("o_orderstatus") == "O", "unit").otherwise("type")
    asked = table(spark, sf, "orders").select(F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")).alias("pointer"), S.discovery_order(field).alias("order"), F.array(name("o_custkey"), name("o_orderkey")).alias("query_ids"))
    results = table(spark, sf, "part").select(name("p_partkey").alias("query_id"), F.col("p_partkey").alias("position"), F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("uri"))
    return S.joined_candidates(asked, results).join(asked.select("pointer", "order"), "pointer")


@query(
    """WITH p AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'http://qudt.org/v' ELSE 'urn:v' END || c_nationkey AS vocabulary, c_mktsegment AS rdf_type, CASE WHEN c_nationkey % 7 = 0 THEN 0 ELSE count(*) END AS n FROM customer GROUP BY c_nationkey, c_mktsegment), o AS (SELECT * FROM p WHERE n > 0 AND vocabulary LIKE 'urn:%'),
    s AS (SELECT DISTINCT o_custkey AS package, 'urn:v' || (o_orderkey % 30) AS vocabulary, ['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE', 'NONE'][o_orderkey % 6 + 1] AS rdf_type FROM orders), c AS (SELECT s.* FROM s JOIN o USING (vocabulary, rdf_type))
    SELECT * FROM c UNION ALL SELECT DISTINCT package, 'urn:any', 'Concept' FROM s WHERE package NOT IN (SELECT package FROM c)"""
)
def vocabulary_routes(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("rdf_type")).agg(F.count("*").alias("n"))
    nation = F.col("c_nationkey")
    profile = c.select(
        F.concat(F.when(nation % 5 == 0, "http://qudt.org/v").otherwise("urn:v"), nation.cast("string")).alias("vocabulary"), "rdf_type", F.when(nation % 7 == 0, 0).otherwise(F.col("n")).alias("count"), F.array(F.lit("label")).alias("properties")
    )
    kinds = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE", "NONE")))
    chosen = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("position"), F.concat(F.lit("urn:v"), (F.col("o_orderkey") % 30).cast("string")).alias("vocabulary"), F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("rdf_type")
    )
    return S.selected_routes(chosen, S.route_options(profile), spark.createDataFrame([("urn:any", "Concept")], "vocabulary string, rdf_type string"))


@query(
    """WITH n AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'T = ' || turn || ' ppm' WHEN 1 THEN 'about ' || turn || ' Hz' ELSE 'none' END AS t, role FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY contains(t, '=') DESC, role = 'user' DESC, turn) AS k FROM n WHERE turn % 3 <> 2)
    SELECT conv_id, CAST(turn AS DOUBLE) AS value, CASE WHEN contains(t, 'Hz') THEN 'Hz' ELSE 'ppm' END AS unit FROM k WHERE k = 1"""
)
def best_quantity(spark, sf):
    t = F.col("turn")
    text = F.when(t % 3 == 0, F.concat(F.lit("T = "), t.cast("string"), F.lit(" ppm"))).when(t % 3 == 1, F.concat(F.lit("about "), t.cast("string"), F.lit(" Hz"))).otherwise("none")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("claim"), F.when(F.col("role") == "user", "instrument_signal").otherwise("other_signal").alias("category"))
    return S.first_quantity(rows, ["conv_id"], "turn", "claim", "category")


@query(
    r"""WITH c AS (SELECT conv_id, turn, turn % 3 = 0 AND regexp_replace(substr(text, 5, 40), '\s', '', 'g') <> '' AS supported FROM conversations) SELECT CASE WHEN NOT supported THEN 'evidence_text_unsupported' ELSE 'candidate_rejected' END AS reason, count(*) AS n FROM c WHERE NOT supported OR turn % 2 = 0 GROUP BY 1"""
)
def filtered_evidence_ledger(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn")
    name = F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    evidence = F.when(t % 3 == 0, F.substring("text", 5, 40)).when(t % 3 == 1, "0123456789").otherwise("0123456789 0123456789 0123456789 01234567")
    candidates = c.select(name.alias("candidate_id"), evidence.alias("evidence_text"), F.col("text").alias("content"))
    yes = [F.lit(v).alias(k) for k, v in E.DEFAULT_ASSESSMENT.items() if k != "groundedness"]
    judged = c.select(name.alias("candidate_id"), F.lit(0).alias("position"), F.when(t % 2 == 0, "no").otherwise("yes").alias("groundedness"), *yes)
    return S.ledger_summary(S.filtered_ledger(candidates, "content", judged)[1])


_PROGRESS = ("pending", "file_ranking", "vocabulary_normalization", "profile_projection", "profile_draft", "completed")


@query(
    """WITH e AS (SELECT event_id AS id, ['running', 'crashed', 'cancelled', 'completed'][event_id % 4 + 1] AS w, ['pending', 'running', 'completed'][event_id % 3 + 1] AS c, ['pending', 'running', 'crashed', 'cancelled', 'completed'][event_id % 5 + 1] AS x,
      CASE WHEN event_id % 7 < 6 THEN ['pending', 'file_ranking', 'vocabulary_normalization', 'profile_projection', 'profile_draft', 'completed'][event_id % 7 + 1] END AS p, event_id % 11 = 0 AS r FROM events),
    s AS (SELECT *, CASE WHEN r OR x = 'completed' THEN 'completed' WHEN w = 'crashed' OR x = 'crashed' THEN 'crashed' WHEN w = 'cancelled' OR x = 'cancelled' THEN 'cancelled' WHEN p <> 'pending' THEN p WHEN x = 'running' THEN 'extraction' WHEN c = 'running' THEN 'chunking' WHEN c = 'completed' THEN 'extraction_pending' ELSE 'pending' END AS stage FROM e),
    n AS (SELECT *, CASE WHEN stage IN ('chunking', 'extraction', 'vocabulary_normalization', 'profile_projection', 'profile_draft', 'completed') THEN 'completed' ELSE 'unknown' END AS context,
      CASE WHEN p = 'file_ranking' THEN 'running' WHEN p IN ('vocabulary_normalization', 'profile_projection', 'profile_draft', 'completed') THEN 'completed' ELSE x END AS extraction, CASE WHEN p = 'vocabulary_normalization' THEN 'running' WHEN p IN ('profile_projection', 'completed') THEN 'completed' ELSE 'unknown' END AS normalization,
      CASE WHEN p = 'profile_projection' THEN 'running' WHEN p IN ('profile_draft', 'completed') THEN 'completed' ELSE 'unknown' END AS projection, CASE WHEN p = 'completed' THEN 'completed' ELSE 'unknown' END AS validation FROM s)
    SELECT id, stage, concat_ws(',', 'completed', CASE WHEN stage = 'completed' THEN 'completed' ELSE context END, CASE WHEN w = 'crashed' AND c <> 'completed' THEN 'crashed' WHEN stage = 'completed' THEN 'completed' ELSE c END, CASE WHEN w = 'crashed' AND c = 'completed' THEN 'crashed' WHEN stage = 'completed' THEN 'completed' ELSE extraction END,
      CASE WHEN stage = 'completed' THEN 'completed' ELSE normalization END, CASE WHEN stage = 'completed' THEN 'completed' ELSE projection END, CASE WHEN stage = 'completed' THEN 'completed' ELSE validation END) AS steps FROM n"""
)
def workflow_steps(spark, sf):
    k = F.col("event_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    e = table(spark, sf, "events").select(
        k.alias("id"), pick(("running", "crashed", "cancelled", "completed"), 4).alias("w"), pick(("pending", "running", "completed"), 3).alias("c"),
        pick(("pending", "running", "crashed", "cancelled", "completed"), 5).alias("x"), pick(_PROGRESS, 7).alias("p"), (k % 11 == 0).alias("r"),
    )
    w, c, x, p = (F.col(n) for n in "wcxp")
    staged = e.withColumn("stage", S.workflow_stage(w, c, x, p, F.col("r"))).withColumn("s", S.step_statuses(F.col("stage"), w, c, x, p))
    return staged.select("id", "stage", F.concat_ws(",", "s.*").alias("steps"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey * p_size * 97 AS n, p_size * 37.5 AS ms FROM part) SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n / 1024 / 1024 * 10 + 0.5) / 10) || ' MB' END AS size,
    CASE WHEN ms >= 1000 THEN printf('%.1f', floor(CAST(ms AS DOUBLE) / 1000 * 10 + 0.5) / 10) || ' s' ELSE CAST(CAST(floor(ms + 0.5) AS BIGINT) AS VARCHAR) || ' ms' END AS duration FROM p"""
)
def formatted_sizes(spark, sf):
    n = F.col("p_partkey") * F.col("p_size") * 97
    return table(spark, sf, "part").select("p_partkey", S.format_bytes(n).alias("size"), S.format_duration(F.col("p_size") * F.lit(37.5)).alias("duration"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type, event_id % 50 AS f FROM events) SELECT 'file' AS side, user_id, CAST(f AS VARCHAR) AS name, string_agg(event_type, ',' ORDER BY event_type) AS members FROM s GROUP BY user_id, f UNION ALL SELECT 'group', user_id, event_type, string_agg(CAST(f AS VARCHAR), ',' ORDER BY CAST(f AS VARCHAR)) FROM s GROUP BY user_id, event_type")
def files_of_groups(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("package"), (F.col("event_id") % 50).cast("string").alias("file_path"), F.col("event_type").alias("group"))
    by_file, by_group = S.files_of_groups(rows)
    one = by_file.select(F.lit("file").alias("side"), F.col("package").alias("user_id"), F.col("file_path").alias("name"), F.array_join("groups", ",").alias("members"))
    return one.unionByName(by_group.select(F.lit("group").alias("side"), F.col("package").alias("user_id"), F.col("group").alias("name"), F.array_join("files", ",").alias("members")))


@query(
    f"WITH {_SUMMARY}, {_GROUP}, c AS (SELECT id, sum(ceil(length(\"group\") / 4)) OVER (PARTITION BY user_id ORDER BY id, \"group\" ROWS UNBOUNDED PRECEDING) AS used, user_id FROM g) SELECT user_id, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM c WHERE used <= 40 GROUP BY user_id"
)
def budgeted_sections(spark, sf):
    from tessera.operators.overview import assign_groups

    s = _summaries(spark, sf)
    sections = assign_groups(s, "id", "summary").join(s.select("id", "user_id"), "id").withColumn("at", F.struct("id", "group"))
    return S.within_budget(sections, ["user_id"], "at", "group", 40).groupBy("user_id").agg(F.count("*").alias("n"), F.max("used").alias("used"))


@query(
    """SELECT url, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*') AS valid FROM (SELECT page_id, url, list_last(string_split(url, '/')) AS name FROM pages)"""
)
def valid_identifiers(spark, sf):
    return table(spark, sf, "pages").select("url", S.valid_identifier(F.element_at(F.split("url", "/"), -1)).alias("valid"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'type,unit' WHEN 'view' THEN 'unit' ELSE '' END AS fields FROM (SELECT DISTINCT event_type FROM events)")
def enrichable_fields(spark, sf):
    slots = F.when(F.col("event_type") == "click", F.array(F.lit("unit"), F.lit("title"), F.lit("type"), F.lit("unit"))).when(F.col("event_type") == "view", F.array(F.lit("unit"))).otherwise(F.array(F.lit("x")))
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", F.array_join(S.enrichable_fields(slots), ",").alias("fields"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, lower(text) AS t, ['Plan', 'QuantitativeAttribute', 'Dataset'][turn % 3 + 1] AS target, CASE WHEN conv_id % 4 = 0 THEN [] ELSE ['user'] END AS allowed FROM conversations)
    SELECT conv_id, turn, len(allowed) = 0 OR list_contains(allowed, role) OR (target = 'QuantitativeAttribute' AND conv_id % 2 = 0) OR (target = 'Plan' AND regexp_matches(t, '\\b(method|procedure|protocol|plan|sampling|acquisition)\\b')) AS allowed FROM c"""
)
def allowed_candidates(spark, sf):
    c = table(spark, sf, "conversations")
    target = F.get(F.array(*map(F.lit, ("Plan", "QuantitativeAttribute", "Dataset"))), (F.col("turn") % 3).cast("int"))
    allowed = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("user")))
    role = F.when(F.col("conv_id") % 2 == 0, "parameter").otherwise("value")
    return c.select("conv_id", "turn", S.candidate_allowed(allowed, F.col("role"), target, role, F.col("text")).alias("allowed"))


# ---------------------------------------------------------------- vocabularies of the star schema's graph

_SCHEMES = "m AS (SELECT 'buyers' AS identifier, 'customer/' || c_custkey AS uri FROM customer UNION SELECT 'places', 'nation/' || n_nationkey FROM nation UNION SELECT 'sellers', 'supplier/' || s_suppkey FROM supplier)"


def _members(spark, sf):
    part = lambda name, scheme, prefix, key: table(spark, sf, name).select(F.lit(scheme).alias("identifier"), F.concat(F.lit(prefix + "/"), F.col(key).cast("string")).alias("uri"))
    gone = table(spark, sf, "nation").select(F.lit("places").alias("identifier"), F.concat(F.lit("nowhere/"), F.col("n_nationkey").cast("string")).alias("uri"))
    every = part("customer", "buyers", "customer", "c_custkey").union(part("nation", "places", "nation", "n_nationkey")).union(part("supplier", "sellers", "supplier", "s_suppkey"))
    return G.import_membership(every.union(every).union(gone), nodes(spark, sf))


@query(f"WITH {_SCHEMES} SELECT identifier, row_number() OVER (PARTITION BY identifier ORDER BY uri) AS position, uri FROM m")
def vocabulary_resources(spark, sf):
    return G.resources_of(_members(spark, sf))


@query(
    f"""WITH {_SCHEMES}, {_NODES}, {_EDGES}, e AS (SELECT s AS uri, p FROM edges UNION SELECT o, p FROM edges), t AS (SELECT identifier, t AS rdf_type, m.uri FROM m JOIN nodes ON nodes.uri = m.uri WHERE t IS NOT NULL)
    SELECT identifier, rdf_type, count(DISTINCT t.uri) AS count, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS relationships FROM t LEFT JOIN e ON e.uri = t.uri GROUP BY ALL"""
)
def scheme_profiles(spark, sf):
    made = G.scheme_profile(_members(spark, sf), nodes(spark, sf), edges(spark, sf).filter("p <> 'basedIn'").union(edges(spark, sf).filter("p = 'basedIn'")))
    return made.select("identifier", "rdf_type", "count", F.array_join("relationships", ",").alias("relationships"))


@query(f"WITH {_NODES} SELECT uri, t AS rdf_type FROM nodes WHERE t IS NOT NULL AND t <> 'Region' AND uri IN (SELECT 'region/' || r_regionkey FROM region UNION SELECT 'supplier/' || s_suppkey FROM supplier)")
def fetched_resources(spark, sf):
    wanted = table(spark, sf, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("uri")).union(table(spark, sf, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))))
    return G.fetch_resources(nodes(spark, sf), wanted, ["Region"]).select("uri", F.array_join("rdf_types", ",").alias("rdf_type"))


@query(f"WITH {_EDGES}, f AS (SELECT s, o FROM edges WHERE p = 'partOf') SELECT 'region/99' AS uri UNION SELECT s FROM f UNION SELECT o FROM f")
def endpoint_uris(spark, sf):
    return G.endpoint_uris(spark.createDataFrame([("region/99",)], "uri string"), edges(spark, sf).filter("p = 'partOf'").select("s", "o"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM edges)) AS n_triples, (SELECT count(*) FROM (SELECT s FROM edges UNION SELECT o FROM edges)) AS n_resources")
def graph_counts(spark, sf):
    e = edges(spark, sf).withColumn("o_kind", F.lit("iri"))
    return G.graph_counts(e.union(e))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'completed' WHEN value > 5 THEN 'repaired' ELSE 'failed' END AS status FROM events")
def repaired_chunks(spark, sf):
    from tessera.streaming.recovery import with_repairs

    chunks = table(spark, sf, "events").select("event_id", "event_type", "value")
    first = lambda df: df.select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    second = lambda df: df.select("event_id", F.when(F.col("value") > 5, "completed").otherwise("failed").alias("status"))
    return with_repairs(chunks, first, second, ["event_id"])

"""Overview and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ledgers as L
from tessera.operators import overview as O
from tessera.operators.checkpoint import stored
from tessera.plans.base import query, table, tasks_for
from tessera.plans.documents import _LEAVES, _orders

_SUMMARY = """s AS (SELECT event_id AS id, user_id, CASE event_id % 6 WHEN 0 THEN 'Acquisition parameters and settings' WHEN 1 THEN 'raw data without audit trail' WHEN 2 THEN 'processed data of the experiment' WHEN 3 THEN 'parameter values' WHEN 4 THEN 'protocol; purpose cannot be told' ELSE 'nothing here' END AS summary FROM events)"""
_GROUP = """g AS (SELECT id, user_id, unnest(CASE id % 6 WHEN 0 THEN ['acquisition_settings', 'instrument_settings'] WHEN 1 THEN ['raw_data'] WHEN 2 THEN ['processed_data'] WHEN 3 THEN ['parameter_settings'] WHEN 4 THEN ['method_program', 'ambiguous_supporting_resources'] ELSE [] END) AS "group" FROM s)"""


def _summaries(spark, sf):
    texts = ("Acquisition parameters and settings", "raw data without audit trail", "processed data of the experiment", "parameter values", "protocol; purpose cannot be told", "nothing here")
    s = F.lit(texts[-1])
    for k, t in enumerate(texts[:-1]):
        s = F.when(F.col("event_id") % 6 == k, F.lit(t)).otherwise(s)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", s.alias("summary"))


@query(f"WITH {_SUMMARY}, {_GROUP} SELECT id, \"group\", CASE WHEN \"group\" IN ('acquisition_settings', 'instrument_settings', 'parameter_settings') THEN 'parameterizes' WHEN \"group\" = 'method_program' THEN 'configures' WHEN \"group\" = 'ambiguous_supporting_resources' THEN 'uncertain_relation' ELSE 'describes' END AS relation FROM g")
def file_groups(spark, sf):
    return O.assign_groups(_summaries(spark, sf), "id", "summary")


@query(
    f"""WITH {_SUMMARY}, {_GROUP}, e AS (SELECT * FROM (VALUES ('method_program', 'configures', 'acquisition_settings'), ('instrument_settings', 'parameterizes', 'acquisition_settings'), ('acquisition_settings', 'parameterizes', 'raw_data'), ('processing_settings', 'parameterizes', 'processed_data'),
    ('processed_data', 'derives_from', 'raw_data'), ('derived_results', 'derives_from', 'processed_data')) t(source, relation, target)) SELECT DISTINCT a.user_id, source, relation, target FROM e JOIN g a ON a."group" = source JOIN g b ON b."group" = target AND a.user_id = b.user_id"""
)
def inferred_role_edges(spark, sf):
    s = _summaries(spark, sf)
    groups = O.assign_groups(s, "id", "summary").join(s.select("id", "user_id"), "id")
    return O.role_edges(groups, ["user_id"])


@query(
    "WITH e AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS edge_id, l_orderkey AS o, l_suppkey AS s, l_returnflag AS f, l_partkey AS p FROM lineitem), d AS (SELECT edge_id, CASE WHEN s % 10 = 0 THEN 'dangling' WHEN o % 100 = s THEN 'self_loop' WHEN f = 'R' THEN 'containment' WHEN p % 4 = 0 THEN 'weak_evidence' END AS r FROM e) SELECT coalesce(r, 'kept') AS outcome, count(*) AS n FROM d GROUP BY 1"
)
def sanitised_edges(spark, sf):
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    e = i.withColumn("edge_id", F.concat_ws("/", *i.columns)).select(
        "edge_id", F.when(F.col("l_suppkey") % 10 == 0, "gone").when(F.col("l_orderkey") % 100 == F.col("l_suppkey"), "n0").otherwise("n1").alias("source"), F.lit("n0").alias("target"),
        F.when(F.col("l_returnflag") == "R", "contains").otherwise(F.concat(F.lit("r"), "edge_id")).alias("relation"),
        F.when(F.col("l_partkey") % 4 == 0, F.array(F.lit("n/a"), F.lit(" "))).otherwise(F.array(F.lit("seen in the log"))).alias("evidence"),
    )
    nodes = spark.createDataFrame([("n0",), ("n1",)], "node_id string")
    seeds = spark.createDataFrame([], "source string, relation string, target string")
    return O.sanitise_edges(e, nodes, seeds).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL WHEN regexp_matches(t, 'instrument|device|equipment|sensor|apparatus') THEN '/was_generated_by/0/carried_out_by/-' WHEN regexp_matches(t, 'experiment|acquisition|generation|measurement activity|workflow') THEN '/was_generated_by/-'
      WHEN role = 'assistant' THEN '/was_generated_by/0/realized_plan' WHEN regexp_matches(t, 'dataset name|title|name') THEN '/title' WHEN regexp_matches(t, 'date|timestamp|modified|modification') THEN '/modification_date' END AS path FROM n"""
)
def note_targets(spark, sf):
    c = table(spark, sf, "conversations")
    category = F.when(F.col("role") == "system", "measurement_signal").when(F.col("role") == "assistant", "method_signal").otherwise("other_signal")
    return c.select("conv_id", "turn", O.note_target(category, F.col("text"))["path"].alias("path"))


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, CASE p_size % 3 WHEN 0 THEN '/a/carried_out_by/0' WHEN 1 THEN '/was_generated_by/2' ELSE '/a/had_output_entity/1' END AS path FROM part),
    r AS (SELECT p_partkey, CASE WHEN path = '/was_generated_by/2' THEN 'activity' WHEN path = '/a/carried_out_by/0' THEN 'agent' ELSE 'output_entity' END AS role FROM p) SELECT p_partkey, role, 'generic' AS family, true AS allowed FROM r"""
)
def attribute_placement(spark, sf):
    p = table(spark, sf, "part")
    path = F.when(F.col("p_size") % 3 == 0, "/a/carried_out_by/0").when(F.col("p_size") % 3 == 1, "/was_generated_by/2").otherwise("/a/had_output_entity/1")
    words = F.concat_ws(" ", "p_name", "p_type")
    made = p.select("p_partkey", O.parent_role(path, words, F.lit("Thing")).alias("role"), O.attribute_family(words).alias("family"))
    return made.withColumn("allowed", O.family_allowed(F.col("role"), F.col("family")))


@query(
    f"""WITH {_LEAVES}, c AS (SELECT id, pointer, CASE WHEN pointer = '/order/status' AND id % 3 = 0 THEN '"X"' ELSE value END AS value FROM l WHERE NOT (pointer = '/parties/0/id' AND id % 5 = 0)), p AS (SELECT o_orderkey AS id, unnest(['/order/priority', '/order/status', '/parties/0/id', '/title']) AS pointer FROM orders),
    j AS (SELECT p.id, p.pointer, CASE WHEN p.pointer = '/title' AND p.id % 7 = 0 THEN 'invalid' WHEN l.value IS NULL AND c.value IS NULL THEN 'missing' WHEN c.value IS NULL THEN 'removed' WHEN l.value IS NULL THEN 'added' WHEN l.value <> c.value THEN 'modified' ELSE 'unchanged' END AS status FROM p LEFT JOIN l ON p.id = l.id AND p.pointer = l.pointer LEFT JOIN c ON p.id = c.id AND p.pointer = c.pointer)
    SELECT pointer, status, count(*) AS n FROM j GROUP BY ALL"""
)
def field_ledger(spark, sf):
    from tessera.operators.documents import leaf_paths

    docs = _orders(spark, sf)
    old = stored(leaf_paths(docs, "id", "doc"), "leaves")  # each document is parsed once, whatever reads its leaves
    new = old.filter("not (pointer = '/parties/0/id' and id % 5 = 0)").withColumn("value", F.when((F.col("pointer") == "/order/status") & (F.col("id") % 3 == 0), '"X"').otherwise(F.col("value")))
    paths = docs.select("id", F.explode(F.array(*map(F.lit, ("/order/priority", "/order/status", "/parties/0/id", "/title")))).alias("pointer"))
    errors = docs.filter("id % 7 = 0").select("id", F.lit("/title").alias("pointer"))
    return L.field_ledger(paths, old, new, old, errors).groupBy("pointer", "status").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LEAVES} SELECT o_orderkey AS id, 'status' AS requirement_id, o_orderstatus <> 'P' AS satisfied FROM orders UNION ALL SELECT o_orderkey, 'parties', true FROM orders UNION ALL SELECT o_orderkey, 'title', false FROM orders"""
)
def requirement_coverage(spark, sf):
    from tessera.operators.documents import leaf_paths

    req = spark.createDataFrame([("status", ["/order/status", "/state"]), ("parties", ["/parties/-"]), ("title", ["/title"])], "requirement_id string, target_paths array<string>")
    docs = _orders(spark, sf)
    return L.path_coverage(req, stored(leaf_paths(docs, "id", "doc"), "leaves"), tasks_for(docs))


@query(
    "WITH a AS (SELECT event_type AS requirement_id, CASE WHEN bool_or(event_id = 0) THEN 'fulfilled' ELSE 'partial' END AS status FROM events WHERE event_type <> 'view' GROUP BY 1), r AS (SELECT DISTINCT event_type AS requirement_id, length(event_type) / 4.0 AS weight FROM events) SELECT r.requirement_id, CAST(weight AS DOUBLE) AS weight, coalesce(status, 'missing') AS status, CAST(CASE status WHEN 'fulfilled' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS quality, CAST(round(CASE status WHEN 'fulfilled' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END * weight, 6) AS DOUBLE) AS weighted_score FROM r LEFT JOIN a USING (requirement_id)"
)
def requirement_report(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("event_type").alias("requirement_id")).distinct().withColumn("weight", F.length("requirement_id") / 4)
    a = e.filter("event_type <> 'view'").select(F.col("event_type").alias("requirement_id"), F.when(F.col("event_id") == 0, "fulfilled").otherwise("partial").alias("status"), F.col("event_id").alias("position"))
    return L.requirement_report(r, a)


@query(
    "SELECT DISTINCT 'region' AS root, path, class, depth FROM (VALUES ('/nations', 'nation', 1), ('/nations/customers', 'customer', 2), ('/nations/suppliers', 'supplier', 2), ('/nations/customers/orders', 'orders', 3)) t(path, class, depth)"
)
def schema_branches(spark, sf):
    slots = spark.createDataFrame([("region", "nations", "nation"), ("nation", "customers", "customer"), ("nation", "suppliers", "supplier"), ("customer", "orders", "orders"), ("orders", "lines", "lineitem")], "class string, slot string, range string")
    return L.branch_index(slots, ["region"], 3)

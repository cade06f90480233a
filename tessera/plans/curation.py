"""Queries over drafts under curation: attribute owners, labels, guards, states, marks, patches, shells."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import drafts as P
from tessera.operators import curation as K
from tessera.operators import documents as D
from tessera.operators import ledgers as L
from tessera.operators import placement as W
from tessera.plans.base import query, table, tasks_for
from tessera.plans.documents import _orders

# Drafts of datasets, one for each order: an activity with two quantities (the second with a unit if the order is filled) and a quality of the whole.
_DRAFTS = """d AS (SELECT o_orderkey AS id, o_orderpriority AS pr, o_custkey AS c, o_orderstatus AS st FROM orders)"""


def _drafts(spark, sf):
    o = table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    first = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("value"), none.alias("has_quantity_type"), none.alias("unit"))
    second = F.struct(F.lit("Mass").alias("title"), F.lit(None).cast("bigint").alias("value"), F.lit("mass").alias("has_quantity_type"), F.when(F.col("o_orderstatus") == "F", "kg").alias("unit"))
    agent = F.struct(F.when(F.col("o_orderstatus") == "O", "NMR instrument").alias("title"), F.lit("a1").alias("id"))
    activity = F.struct(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Activity "), F.col("o_orderpriority"))).alias("title"), F.array(agent).alias("carried_out_by"), F.array(first, second).alias("has_quantitative_attribute"))
    doc = F.to_json(F.struct(F.array(activity).alias("was_generated_by"), F.array(F.struct(F.col("o_orderstatus").alias("title"))).alias("has_qualitative_attribute")))
    return o.select(F.col("o_orderkey").alias("id"), doc.alias("doc"))


def _leaves(spark, sf):
    return D.leaf_paths(_drafts(spark, sf), "id", "doc")


_Q = "'/was_generated_by/0/has_quantitative_attribute'"


@query(
    f"""WITH {_DRAFTS} SELECT id, {_Q} AS "array", 0 AS "index", 'title' AS field, pr AS value FROM d UNION ALL SELECT id, {_Q}, 0, 'value', CAST(c AS VARCHAR) FROM d UNION ALL SELECT id, {_Q}, 1, 'title', 'Mass' FROM d
    UNION ALL SELECT id, {_Q}, 1, 'has_quantity_type', 'mass' FROM d UNION ALL SELECT id, {_Q}, 1, 'unit', 'kg' FROM d WHERE st = 'F' UNION ALL SELECT id, '/has_qualitative_attribute', 0, 'title', st FROM d"""
)
def attribute_items(spark, sf):
    return K.attribute_items(_leaves(spark, sf))


@query(
    f"""WITH {_DRAFTS} SELECT id, {_Q} || '/1/has_quantity_type' AS pointer, 'has_quantity_type' AS field, 'mass' AS value, false AS synthetic FROM d UNION ALL SELECT id, {_Q} || '/1/unit', 'unit', 'kg', false FROM d WHERE st = 'F'
    UNION ALL SELECT id, {_Q} || '/1/unit', 'unit', 'mass', true FROM d WHERE st <> 'F'"""
)
def vocabulary_sources(spark, sf):
    return K.vocabulary_sources(_leaves(spark, sf), ("type", "has_quantity_type", "unit"))


@query(
    f"""WITH {_DRAFTS} SELECT id, '/was_generated_by/0' AS path, 'DataGeneratingActivity' AS class, 'Activity ' || pr AS title, '' AS description FROM d WHERE st <> 'P' UNION ALL SELECT id, '/was_generated_by/0/carried_out_by/0', 'AgenticEntity', 'NMR instrument', '' FROM d WHERE st = 'O'"""
)
def attribute_owners(spark, sf):
    return K.attribute_owners(_leaves(spark, sf))


@query(
    r"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' - ' || p_size AS label, string_split(p_name, ' ') AS words FROM part),
    r AS (SELECT p_partkey, label, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '\b' || words[1] || '\b', '', 'gi'), '\b' || words[2] || '\b', '', 'gi'), '\s*-\s*\d+\s*$', ''), '\s*-\s*$', ''), '\s+', ' ', 'g')) AS less FROM p)
    SELECT p_partkey, CASE WHEN less <> '' AND less <> label THEN less END AS cleaned FROM r"""
)
def cleaned_labels(spark, sf):
    label = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" - "), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", K.clean_label(label, K.title_words(F.col("p_name"))).alias("cleaned"))


@query(
    """WITH a AS (SELECT l_orderkey AS id, l_linenumber % 3 AS activity, l_returnflag AS f, 'a' || (l_linenumber % 3) AS own, CASE WHEN l_returnflag = 'A' THEN 'a' || (l_suppkey % 3) WHEN l_linestatus = 'O' THEN '' ELSE 'e' || l_suppkey END AS target,
    CASE WHEN l_partkey % 5 = 0 THEN 'activity_evaluation_target' ELSE '' END AS title, CASE WHEN l_partkey % 7 = 0 THEN 'a requirement' WHEN l_partkey % 11 = 0 THEN 'a requirement with evidence' ELSE '' END AS description FROM lineitem)
    SELECT id, activity, count(*) FILTER (f <> 'N' AND NOT (f = 'A' AND own = target) AND title = '' AND description <> 'a requirement' AND (target <> '' OR description <> '')) AS n_targets, count(*) FILTER (f = 'A' AND own = target) AS self_references FROM a GROUP BY ALL"""
)
def activity_targets(spark, sf):
    i = table(spark, sf, "lineitem")
    own = F.concat(F.lit("a"), (F.col("l_linenumber") % 3).cast("string"))
    rows = i.select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("activity"), own.alias("activity_id"),
        F.when(F.col("l_returnflag") == "A", "evaluated_activity").when(F.col("l_returnflag") == "R", "evaluated_entity").alias("relation"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string"))).when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("e"), F.col("l_suppkey").cast("string"))).alias("target_id"),
        F.when(F.col("l_partkey") % 5 == 0, "activity_evaluation_target").otherwise("").alias("title"),
        F.when(F.col("l_partkey") % 7 == 0, "a requirement").when(F.col("l_partkey") % 11 == 0, "a requirement with evidence").otherwise("").alias("description"),
    )
    return K.concrete_targets(rows)


_GUARDED = ("attribute_range_decomposition", "technical_agent_kind", "activity_evaluation_target", "method_plan_presence", "dataset_title_identity")


@query(
    """WITH r AS (SELECT o_orderkey AS id, unnest(['attribute_range_decomposition', 'technical_agent_kind', 'activity_evaluation_target', 'method_plan_presence', 'dataset_title_identity']) AS requirement_id,
      CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'partial' ELSE 'missing' END AS st, o_custkey AS c, o_orderkey AS o FROM orders),
    f AS (SELECT *, CASE WHEN st = 'fulfilled' AND o % 2 = 1 THEN CASE WHEN c % 2 = 0 THEN 'partial' ELSE 'missing' END ELSE st END AS u, o % 3 AS acts, least(c % 4, o % 3) AS targeted, least(c % 3, o % 3) AS planned FROM r)
    SELECT id, requirement_id, CASE requirement_id WHEN 'attribute_range_decomposition' THEN CASE WHEN c % 2 > 0 THEN 'partial' ELSE 'fulfilled' END WHEN 'technical_agent_kind' THEN CASE WHEN o % 4 > 0 AND o % 4 = c % 4 THEN 'fulfilled' ELSE u END
      WHEN 'activity_evaluation_target' THEN CASE WHEN acts = 0 OR targeted = 0 THEN 'missing' WHEN c % 5 = 0 OR targeted < acts THEN 'partial' ELSE 'fulfilled' END
      WHEN 'method_plan_presence' THEN CASE WHEN acts = 0 OR planned = 0 THEN 'missing' WHEN planned < acts THEN 'partial' ELSE u END ELSE u END AS status FROM f"""
)
def guarded_requirements(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    acts = o % 3
    facts = {
        "bad_ranges": c % 2, "agents": o % 4, "technical_agents": F.when(o % 4 == c % 4, o % 4).otherwise(0), "activities": acts,
        "targeted": F.least(c % 4, acts), "planned": F.least(c % 3, acts), "self_references": (c % 5 == 0).cast("int"),
    }
    status = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "O", "partial").otherwise("missing")
    rows = table(spark, sf, "orders").withColumn("requirement_id", F.explode(F.array(*map(F.lit, _GUARDED))))
    return rows.select(o.alias("id"), "requirement_id", K.guard_status(F.col("requirement_id"), status, c % 2 == 0, o % 2 == 0, facts).alias("status"))


@query(
    """WITH c AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size / 50.0 END::DOUBLE AS m FROM part WHERE p_partkey % 4 <> 0), u AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS k FROM lineitem)
    SELECT id, round(coalesce(avg(m), 0), 6) AS score, count(m) AS used_evidence_count FROM u LEFT JOIN c USING (k) GROUP BY id"""
)
def source_trace_scores(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("candidate_id"))
    known = table(spark, sf, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50.0).alias("evidence_match_score"))
    return K.source_trace(used, known)


@query(
    """WITH i AS (SELECT o_orderkey AS id, 'schema_invalid:/order/status' AS x FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey, 'requirement_unmet:req' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'
      UNION SELECT l_orderkey, 'field_completion_issue:/parties/' || l_linenumber FROM lineitem WHERE l_discount >= 0.09), s AS (SELECT id, string_agg(x, ',' ORDER BY x) AS issues, bool_or(x LIKE 'requirement%') AS unmet FROM i GROUP BY id),
    a AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'A') AS used FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, o_orderstatus <> 'P' AS schema_valid, CASE WHEN a.id IS NOT NULL THEN o_orderstatus <> 'P' AND NOT coalesce(unmet, false) END AS profile_conformant, CASE WHEN a.id IS NOT NULL THEN used > 0 END AS evidence_grounded, coalesce(issues, '') AS issues
    FROM orders LEFT JOIN s ON s.id = o_orderkey LEFT JOIN a ON a.id = o_orderkey"""
)
def document_quality_states(spark, sf):
    o, i = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    errors = o.filter("o_orderstatus = 'P'").select("id", F.lit("/order/status").alias("pointer"))
    status = F.when(F.col("l_returnflag") == "R", "missing").when(F.col("l_returnflag") == "A", "fulfilled").otherwise("not_applicable")
    asked = i.select("id", F.concat(F.lit("req"), F.col("l_linenumber").cast("string")).alias("requirement_id"), status.alias("status"), (F.col("l_linestatus") == "O").alias("applicable"))
    fields = i.select("id", F.concat(F.lit("/parties/"), F.col("l_linenumber").cast("string")).alias("pointer"), F.when(F.col("l_discount") >= 0.09, "invalid").otherwise("unchanged").alias("status"))
    trace = i.groupBy("id").agg(F.count_if(F.col("l_returnflag") == "A").alias("used_evidence_count"))
    return K.quality_state(o, errors, asked, fields, trace).withColumn("issues", F.array_join("issues", ","))


@query(
    """WITH m AS (SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN '/order/priority' ELSE '/parties/' || (l_linenumber - 2) || '/id' END AS pointer, max(l_returnflag) AS mark FROM lineitem GROUP BY ALL), g AS (SELECT o_orderkey AS id, '/order/priority' AS pointer FROM orders)
    SELECT coalesce(g.id, m.id) AS id, coalesce(g.pointer, m.pointer) AS pointer, CASE WHEN g.id IS NOT NULL THEN 'priority' ELSE 'id' END AS field_name, coalesce(mark, 'pending') AS status, CASE WHEN mark IS NULL THEN 'non_enriched,other' WHEN g.id IS NULL THEN '' ELSE 'other' END AS categories,
    CASE WHEN mark IS NULL THEN 'why' ELSE '' END AS edit_needed_reason FROM g FULL JOIN m ON g.id = m.id AND g.pointer = m.pointer"""
)
def curated_ledger(spark, sf):
    ledger = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("/order/priority").alias("pointer"), F.lit("priority").alias("field_name"), F.lit("pending").alias("status"),
        F.array(F.lit("non_enriched"), F.lit("other")).alias("issue_categories"), F.lit("why").alias("edit_needed_reason"),
    )
    party = F.concat(F.lit("/parties/"), (F.col("l_linenumber") - 2).cast("string"), F.lit("/id"))
    marks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") == 1, "/order/priority").otherwise(party).alias("pointer"), F.col("l_returnflag").alias("status"))
    made = K.mark_curated(ledger, marks)
    return made.withColumn("categories", F.array_join("issue_categories", ",")).drop("issue_categories")


@query("SELECT event_id, '/a/' || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || (event_id % 3) END AS target, event_type = 'click' OR (event_type = 'view' AND event_id % 3 = 1) AS allowed FROM events")
def allowed_write_paths(spark, sf):
    target = F.concat(F.lit("/a/"), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("event_id") % 3).cast("string"))))
    return table(spark, sf, "events").select("event_id", target.alias("target"), K.path_allowed(target, F.array(F.lit("/a/click/"), F.lit("/a/view/1"))).alias("allowed"))


@query(
    """WITH w AS (SELECT DISTINCT l_orderkey AS id, 'i' || (l_suppkey % 100) AS i, 't' || (l_partkey % 50) AS t FROM lineitem), e AS (SELECT o_orderkey AS id, 'i' || (o_custkey % 100) AS i, 't' || (o_custkey % 50) AS t FROM orders)
    SELECT w.id, w.i AS instance_id, w.t AS title, w.i = e.i OR w.t = e.t AS duplicate FROM w JOIN e USING (id)"""
)
def duplicate_writes(spark, sf):
    name = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    writes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("/parties").alias("target"), name("i", "l_suppkey", 100).alias("instance_id"), F.concat(F.lit("  "), name("t", "l_partkey", 50)).alias("title"), F.lit("x").alias("type")).distinct()
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("/parties").alias("target"), name("i", "o_custkey", 100).alias("instance_id"), F.upper(name("t", "o_custkey", 50)).alias("title"), F.lit("X ").alias("type"))
    return K.duplicate_writes(writes, held).select("id", "instance_id", F.trim("title").alias("title"), "duplicate")


@query(
    """WITH n AS (SELECT conv_id AS activity, turn AS position, CASE turn % 5 WHEN 0 THEN 'data/file.csv' WHEN 1 THEN 'Sample ' || (turn % 3) ELSE '' END AS title, CASE WHEN turn % 7 = 0 THEN '' ELSE 'Description ' || (turn % 4) END AS description FROM conversations),
    k AS (SELECT *, CASE WHEN title <> '' THEN title ELSE description END AS label FROM n WHERE turn_ok), s AS (SELECT *, 'pkg:input-entity:' || trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS instance_id FROM k),
    f AS (SELECT *, row_number() OVER (PARTITION BY activity, instance_id ORDER BY position) AS r FROM s) SELECT activity, position, instance_id, title, description FROM f WHERE r = 1 AND NOT (activity % 2 = 0 AND instance_id = 'pkg:input-entity:sample-1')""".replace(
        "WHERE turn_ok", "WHERE title <> 'data/file.csv' AND (title <> '' OR description <> '')"
    )
)
def relation_appends(spark, sf):
    t = F.col("turn")
    title = F.when(t % 5 == 0, "data/file.csv").when(t % 5 == 1, F.concat(F.lit(" Sample "), (t % 3).cast("string"))).otherwise("")
    description = F.when(t % 7 == 0, "").otherwise(F.concat(F.lit("Description "), (t % 4).cast("string")))
    intents = table(spark, sf, "conversations").select(F.col("conv_id").alias("activity"), t.alias("position"), title.alias("title"), description.alias("description"))
    held = intents.filter("activity % 2 = 0").select("activity", F.lit("pkg:input-entity:sample-1").alias("instance_id")).distinct()
    return K.append_relations(held, intents, "input-entity", F.lit("pkg"))


_ATTRIBUTES = "a AS (SELECT l_orderkey AS id, l_linenumber AS position, min(l_partkey) AS p, min(l_discount) AS value, min(l_returnflag) AS label FROM lineitem GROUP BY ALL)"


def _attributes(spark, sf):
    """An order's lines meet in one of as many tasks as the lines need, so what a task holds doesn't grow with the table."""
    lines = table(spark, sf, "lineitem")
    own = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), "l_partkey", "l_discount", "l_returnflag").repartition(tasks_for(lines), "id")
    return own.groupBy("id", "position").agg(F.min("l_partkey").alias("p"), F.min("l_discount").alias("value"), F.min("l_returnflag").alias("label"))


@query(
    f"""WITH {_ATTRIBUTES}, g AS (SELECT *, '/a/' || (p % 3) AS arr, first_value(position) OVER (PARTITION BY id, label, value ORDER BY p % 7 DESC, position) AS survivor FROM a),
    n AS (SELECT id, label, value, count(DISTINCT arr) AS k FROM g GROUP BY ALL) SELECT g.id, position, arr AS "array", survivor FROM g JOIN n USING (id, label, value) WHERE k > 1 AND position <> survivor"""
)
def cross_parent_duplicates(spark, sf):
    """Values are moved by less than the tolerance; the SQL has them as they are."""
    nearly = F.col("value") * (1 + (F.col("position") % 3) * 1e-7)
    rows = _attributes(spark, sf).select("id", "position", F.concat(F.lit("/a/"), (F.col("p") % 3).cast("string")).alias("array"), "label", nearly.alias("value"), F.lit("").alias("unit"), (F.col("p") % 7).alias("score"))
    return K.cross_parent_duplicates(rows)


@query(
    f"""WITH {_ATTRIBUTES}, w AS (SELECT id, position, unnest(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS word FROM a JOIN part ON p = p_partkey), t AS (SELECT DISTINCT id, word FROM w WHERE position % 2 = 1)
    SELECT id, '/was_generated_by/0' AS activity, position AS "index" FROM w JOIN t USING (id, word) WHERE position % 2 = 0 GROUP BY ALL HAVING count(*) >= 2"""
)
def misplaced_attributes(spark, sf):
    named = _attributes(spark, sf).join(table(spark, sf, "part"), F.col("p") == F.col("p_partkey"))
    array = F.when(F.col("position") % 2 == 0, "/was_generated_by/0/has_quantitative_attribute").otherwise("/was_generated_by/0/evaluated_entity/0/has_quantitative_attribute")
    rows = named.select("id", array.alias("array"), F.col("position").alias("index"), F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return K.misplaced_attributes(rows.repartition(tasks_for(table(spark, sf, "lineitem")), "id"))


# ---------------------------------------------------------------- documents and schemas

_OPERATIONS = [
    {"op": "test", "path": "/parties/0/id", "value": 7},
    {"op": "add", "path": "/parties/0", "value": {"id": 0}},
    {"op": "copy", "from": "/parties/0", "path": "/parties/-"},
    {"op": "move", "from": "/order/priority", "path": "/priority"},
    {"op": "replace", "path": "/order", "value": {}},
    {"op": "remove", "path": "/parties/0"},
]


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 7 THEN '{"order": {}, "parties": [{"id": 7}, {"id": 0}], "priority": "' || o_orderpriority || '"}' END AS document, o_custkey % 10 <> 7 AS failed FROM orders"""
)
def json_patched(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("priority")).alias("order"), F.array(F.struct((F.col("o_custkey") % 10).alias("id"))).alias("parties")))
    made = o.select(F.col("o_orderkey").alias("id"), D.patched(doc, F.lit(json.dumps(_OPERATIONS))).alias("x"))
    return made.select("id", F.when(F.col("x.error").isNull(), F.col("x.document")).alias("document"), F.col("x.error").isNotNull().alias("failed"))


_SCAFFOLD = [{"path": "/order/status", "value": "F", "prune_if_unchanged": True}, {"path": "/parties/0", "value": {"id": 7}, "prune_if_unchanged": True}, {"path": "/order/priority", "value": "5-LOW", "prune_if_unchanged": False}]


@query(
    """SELECT o_orderkey AS id, '{"order": {"priority": "' || o_orderpriority || '"' || CASE WHEN o_orderstatus = 'O' THEN ', "status": "O"' ELSE '' END || '}' || CASE WHEN o_custkey = 7 THEN '' ELSE ', "parties": [{"id": ' || o_custkey || '}]' END || '}' AS document FROM orders"""
)
def pruned_scaffolds(spark, sf):
    return _orders(spark, sf).select("id", D.changed(F.col("doc"), P.prune_scaffold, _SCAFFOLD).alias("document"))


_SHAPE = {"order": {"priority": ["x"], "status": "none"}, "parties": ""}


@query(
    """SELECT o_orderkey AS id, '{"order": {"priority": ["' || o_orderpriority || '"], "status": "' || CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END || '"}, "parties": "' || 'c' || o_custkey || '; d' || '"}' AS document FROM orders"""
)
def coerced_shapes(spark, sf):
    o = table(spark, sf, "orders")
    order = F.struct(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" "), "o_orderstatus")).alias("status"))
    doc = F.to_json(F.struct(order.alias("order"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit(" "), F.lit("d")).alias("parties"), F.lit(1).alias("extra")))
    return o.select(F.col("o_orderkey").alias("id"), D.changed(doc, _shaped, _SHAPE).alias("document"))


def _shaped(doc, shape):
    return P.coerce(shape, doc)


_DRAFT_SCHEMA = {
    "type": "object",
    "required": ["title", "type"],
    "properties": {
        "title": {"type": "array", "items": {"type": "string"}},
        "type": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/Term"}]},
        "kind": {"enum": ["raw", "derived"]},
        "terms": {"type": "array", "items": {"$ref": "#/$defs/Term"}},
        "size": {"type": "integer"},
        "part": {"type": "object", "properties": {"part": {"type": "object", "properties": {"part": {"type": "object", "properties": {"x": {"type": "string"}}}}}}},
    },
    "$defs": {"Term": {"title": "DefinedTerm", "type": "object", "properties": {"id": {"type": "string"}, "title": {"type": "string"}, "from_CV": {"type": "string"}}}, "Unused": {"type": "string"}},
}


@query(
    """SELECT * FROM (VALUES (false, '/kind', '"raw"'), (false, '/part/part/part', '{}'), (false, '/size', '0'), (false, '/terms', '[]'), (false, '/title', '[]'), (false, '/type/from_CV', '""'), (false, '/type/id', '""'), (false, '/type/title', '""'),
    (true, '/title', '[]'), (true, '/type', '{}')) t(required_only, pointer, value)"""
)
def schema_shells(spark, sf):
    rows = [(required, p, v) for required in (False, True) for p, v in P.shell_leaves(P.shell(_DRAFT_SCHEMA, required_only=required))]
    return spark.createDataFrame(rows, "required_only boolean, pointer string, value string")


@query("SELECT * FROM (VALUES ('/title/-', 'append,replace,remove,merge'), ('/size', 'replace,remove'), ('/terms', 'append,replace,remove,merge'), ('$defs', 'Term')) t(path, modes)")
def patch_schema_branches(spark, sf):
    made = P.patch_schema(_DRAFT_SCHEMA, ["/title/-", "/size", "/nowhere", "/terms", "/size"])
    rows = [(b["oneOf"][0]["properties"]["target_path"]["const"], ",".join(o["properties"]["mode"]["const"] for o in b["oneOf"])) for b in made["properties"]["writes"]["items"]["oneOf"]]
    return spark.createDataFrame([*rows, ("$defs", ",".join(sorted(made["$defs"])))], "path string, modes string")


@query(
    """SELECT c_custkey AS id, 'urn:' || c_mktsegment AS single, '[' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '{"id": "urn:old"}, ' END || '{"id": "urn:' || c_mktsegment || '", "title": "' || c_mktsegment || '", "from_CV": "urn:cv"}]' AS many FROM customer"""
)
def term_values(spark, sf):
    c = table(spark, sf, "customer")
    held = F.when(F.col("c_custkey") % 2 == 1, '[{"id": "urn:old"}]').otherwise("null")
    row = F.to_json(F.struct(F.concat(F.lit("urn:"), "c_mktsegment").alias("uri"), F.col("c_mktsegment").alias("title"), held.alias("existing")))
    return c.select(F.col("c_custkey").alias("id"), F.from_json(D.changed(row, _term, "/size"), "v string")["v"].alias("single"), F.from_json(D.changed(row, _term, "/terms"), "v string")["v"].alias("many"))


def _term(row, path):
    from tessera.functions import jsonpointer as J

    made = P.term_value(J.schema_at(_DRAFT_SCHEMA, path), _DRAFT_SCHEMA, row["uri"], row["title"], "urn:cv", json.loads(row["existing"]))
    return {"v": made if isinstance(made, str) else json.dumps(made)}


# ---------------------------------------------------------------- operators of ledgers and placement


@query("SELECT DISTINCT l_suppkey AS unit FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 10 = 3")
def compatible_units(spark, sf):
    i = table(spark, sf, "lineitem")
    s = i.select(F.col("l_suppkey").alias("s"), F.when(F.col("l_returnflag") == "R", "qudt__hasQuantityKind").otherwise("other").alias("p"), F.concat(F.lit("k"), (F.col("l_partkey") % 10).cast("string")).alias("o"))
    return W.compatible_units(s, "k3")


@query(
    """SELECT p_partkey, p_name || ' minimum' AS title, CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS value FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, p_name || ' maximum', CAST(CAST(p_size + 5 AS DOUBLE) AS VARCHAR) FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, p_name, CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 <> 0"""
)
def decomposed_ranges(spark, sf):
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("from "), size, F.lit(" to "), (F.col("p_size") + 5).cast("string"))).otherwise(size)
    return L.decompose_ranges(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), value.alias("value")), "title", "value")


@query(
    """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN c_custkey % 2 = 0 THEN 'b,c' ELSE 'a' || ',' || 'c' END AS rejected FROM customer"""
)
def query_ledgers(spark, sf):
    ids = lambda *x: F.array(*map(F.lit, x))
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("old").alias("version"), ids("a", "b", "c").alias("result_ids"), ids("b").alias("selected_ids"))
    new = old.filter("query_id % 2 = 0").select("query_id", F.lit("new").alias("version"), "result_ids", ids("a").alias("selected_ids"))
    return L.query_ledger(old, new).select("query_id", "version", F.array_join("rejected_ids", ",").alias("rejected"))


@query(
    f"""WITH {_DRAFTS}, f AS (SELECT id, {_Q} || '/0/title' AS pointer, pr AS own, pr, st FROM d UNION ALL SELECT id, {_Q} || '/0/value', pr, pr, st FROM d UNION ALL SELECT id, {_Q} || '/1/title', 'Mass', pr, st FROM d UNION ALL SELECT id, {_Q} || '/1/has_quantity_type', 'Mass', pr, st FROM d
      UNION ALL SELECT id, {_Q} || '/1/unit', 'Mass', pr, st FROM d WHERE st = 'F' UNION ALL SELECT id, '/was_generated_by/0/title', NULL, pr, st FROM d WHERE st <> 'P'
      UNION ALL SELECT id, '/was_generated_by/0/carried_out_by/0/title', 'NMR instrument', pr, st FROM d WHERE st = 'O' UNION ALL SELECT id, '/was_generated_by/0/carried_out_by/0/id', CASE WHEN st = 'O' THEN 'NMR instrument' END, pr, st FROM d WHERE st <> 'P')
    SELECT id, pointer, concat_ws(' > ', CASE WHEN st <> 'P' THEN 'Activity ' || pr END, own) AS context FROM f UNION ALL SELECT id, '/has_qualitative_attribute/0/title', st FROM d"""
)
def ancestor_labels(spark, sf):
    return L.ancestor_labels(_leaves(spark, sf))


_BRANCHES = (
    (0, "title", "string", 0, True, "dataset title name"),
    (1, "carried_out_by", "AgenticEntity", 1, False, "instrument device software agent"),
    (2, "was_generated_by", "DataGeneratingActivity", 0, True, "activity method acquisition"),
    (3, "description", "string", 0, False, "dataset description text"),
)


@query(
    """WITH q AS (SELECT event_id AS query_id, CASE event_id % 4 WHEN 0 THEN ['dataset_identity'] WHEN 1 THEN ['device'] WHEN 2 THEN ['method', 'parameter_setting'] ELSE ['parameter_setting'] END AS h, CASE event_id % 3 WHEN 0 THEN ['dataset', 'title'] WHEN 1 THEN ['instrument', 'acquisition'] ELSE ['nothing'] END AS w FROM events),
    b AS (SELECT * FROM (VALUES (0, 'title', 0, 5, ['dataset', 'title', 'name']), (1, 'carried_out_by', 1, 0, ['instrument', 'device', 'software', 'agent']), (2, 'was_generated_by', 0, 5, ['activity', 'method', 'acquisition']), (3, 'description', 0, 0, ['dataset', 'description', 'text'])) t(branch_id, slot, depth, rec, words)),
    s AS (SELECT query_id, branch_id, 2 * len(list_intersect(w, words)) + rec - 20 * depth + CASE WHEN list_contains(h, 'device') AND branch_id = 1 THEN 75 ELSE 0 END + CASE WHEN list_contains(h, 'method') AND branch_id = 2 THEN 50 ELSE 0 END + CASE WHEN list_contains(h, 'dataset_identity') AND branch_id = 0 THEN 40 ELSE 0 END
      - CASE WHEN slot IN ('title', 'description') AND NOT list_contains(h, 'dataset_identity') THEN 25 ELSE 0 END - CASE WHEN h = ['parameter_setting'] THEN 25 ELSE 0 END AS score FROM q, b)
    SELECT query_id, branch_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch_id) AS INTEGER) AS position FROM s WHERE score > 0"""
)
def branch_scores(spark, sf):
    k = F.col("event_id")
    words = lambda *x: F.array(*map(F.lit, x))
    hints = F.when(k % 4 == 0, words("dataset_identity")).when(k % 4 == 1, words("device")).when(k % 4 == 2, words("method", "parameter_setting")).otherwise(words("parameter_setting"))
    text = F.when(k % 3 == 0, "the dataset title").when(k % 3 == 1, "instrument and acquisition").otherwise("nothing")
    queries = table(spark, sf, "events").select(k.alias("query_id"), text.alias("text"), hints.alias("hints"))
    branches = spark.createDataFrame(list(_BRANCHES), "branch_id int, slot string, range_class string, depth int, recommended boolean, text string")
    return L.rank_branches(branches, queries)

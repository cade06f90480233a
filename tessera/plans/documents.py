"""Queries over nested JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.plans.base import query, table


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).alias("order"), F.array(F.struct(F.col("o_custkey").alias("id"))).alias("parties")))
    return o.select(F.col("o_orderkey").alias("id"), doc.alias("doc"))


@query("SELECT event_id AS id, '/' || k AS pointer, 'number' AS type, CAST(json_extract(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaf_paths(spark, sf):
    return D.leaf_paths(table(spark, sf, "events"), "event_id", "props")


_LEAVES = """l AS (SELECT o_orderkey AS id, '/order/priority' AS pointer, '"' || o_orderpriority || '"' AS value FROM orders UNION ALL SELECT o_orderkey, '/order/status', '"' || o_orderstatus || '"' FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, '/parties/0/id', CAST(o_custkey AS VARCHAR) FROM orders)"""


@query(
    f"""WITH {_LEAVES}, c AS (SELECT id, pointer, CASE WHEN pointer = '/order/status' AND id % 3 = 0 THEN '"X"' ELSE value END AS value FROM l WHERE NOT (pointer = '/parties/0/id' AND id % 5 = 0)),
    j AS (SELECT l.id, l.pointer, CASE WHEN c.value IS NULL THEN 'auto_removed' WHEN l.value <> c.value THEN 'auto_modified' ELSE 'unchanged' END AS status FROM l LEFT JOIN c ON l.id = c.id AND l.pointer = c.pointer) SELECT pointer, status, count(*) AS n FROM j GROUP BY ALL"""
)
def json_diff(spark, sf):
    old = D.leaf_paths(_orders(spark, sf), "id", "doc")
    new = old.filter("not (pointer = '/parties/0/id' and id % 5 = 0)").withColumn("value", F.when((F.col("pointer") == "/order/status") & (F.col("id") % 3 == 0), '"X"').otherwise(F.col("value")))
    return D.diff(old, new).groupBy("pointer", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_LEAVES}, e AS (SELECT o_orderkey AS id, unnest(['/order/priority', '/order/status', '/parties/0/id', '/title']) AS pointer FROM orders) SELECT e.id, count(l.id) AS filled, count(*) AS total, round(count(l.id) / count(*), 6) AS ratio FROM e LEFT JOIN l ON e.id = l.id AND e.pointer = l.pointer GROUP BY e.id")
def coverage_counts(spark, sf):
    docs = _orders(spark, sf)
    expected = docs.select("id", F.explode(F.array(*map(F.lit, ("/order/priority", "/order/status", "/parties/0/id", "/title")))).alias("pointer"))
    return D.coverage_counts(expected, D.leaf_paths(docs, "id", "doc"))


@query("SELECT o_orderkey AS id, '\"' || o_orderpriority || '\"' AS priority, CASE WHEN o_orderstatus <> 'P' THEN '\"' || o_orderstatus || '\"' END AS status FROM orders")
def pointer_lookup(spark, sf):
    return _orders(spark, sf).select("id", D.get_pointer(F.col("doc"), F.lit("/order/priority")).alias("priority"), D.get_pointer(F.col("doc"), F.lit("/order/status")).alias("status"))


@query("""SELECT o_orderkey AS id, '{"order": {"priority": "' || o_orderpriority || '", "status": "done"}, "parties": [{"id": ' || o_custkey || '}, {"id": 0}]}' AS document FROM orders""")
def patched_documents(spark, sf):
    writes = F.lit('[{"op": "append", "path": "/parties/-", "value": {"id": 0}}, {"op": "replace", "path": "/order/status", "value": "done"}]')
    return _orders(spark, sf).select("id", D.apply_writes(F.col("doc"), writes)["document"].alias("document"))


_SCHEMA = {"type": "object", "properties": {"order": {"type": "object", "required": ["priority", "status"]}, "parties": {"type": "array", "minItems": 1}}, "required": ["order", "parties"]}


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n_issues, CASE WHEN o_orderstatus = 'P' THEN '/order' ELSE '' END AS first_pointer FROM orders")
def validation_issues(spark, sf):
    found = _orders(spark, sf).select("id", D.validation_issues(F.col("doc"), _SCHEMA).alias("x"))
    return found.select("id", F.size("x").alias("n_issues"), F.coalesce(F.get("x", F.lit(0))["pointer"], F.lit("")).alias("first_pointer"))


@query(f"""WITH {_LEAVES} SELECT 'urn:order:' || id AS s, CASE WHEN pointer = '/order/priority' THEN 'urn:p:priority' ELSE 'urn:p:status' END AS p, trim(value, '"') AS o FROM l WHERE pointer <> '/parties/0/id'""")
def jsonld_triples(spark, sf):
    return D.to_triples(D.leaf_paths(_orders(spark, sf), "id", "doc"), "urn:order:", {"priority": "urn:p:priority", "status": "urn:p:status"})


@query(
    """WITH g AS (SELECT l_orderkey, lower(l_returnflag) AS label, l_discount AS v, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, label, v) - 1 AS n FROM g)
    SELECT l.l_orderkey, l_linenumber, k.label, l_discount AS value, k.n AS "group" FROM lineitem l JOIN k ON k.l_orderkey = l.l_orderkey AND k.label = lower(l_returnflag) AND k.v = l_discount"""
)
def attribute_groups(spark, sf):
    """Values are moved by less than the tolerance; the SQL has them as they are."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.normalise_label("l_returnflag").alias("label"), (F.col("l_discount") * (1 + (F.col("l_linenumber") % 3) * 1e-7)).alias("value"))
    return D.group_attributes(items, "l_orderkey", "l_linenumber", "label", "value").withColumn("value", F.round("value", 4))

"""Schema issues of documents made from orders and their lines."""

from pyspark.sql import functions as F

from tessera.operators import validation as V
from tessera.plans.base import query, table

SCHEMA = {
    "type": "object",
    "required": ["lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10},
        "status": {"enum": ["O", "F"]},
        "priority": {"type": "string", "pattern": "^[1-3]-"},
        "buyer": {"anyOf": [{"type": "string", "maxLength": 5}, {"type": "object", "required": ["id"], "properties": {"id": {"type": "number", "maximum": 1000}}}]},
        "lines": {"type": "array", "maxItems": 6, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {"line": {"type": "object", "properties": {"q": {"type": "number", "maximum": 45}}}},
}


def _documents(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("q"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["q"].alias("q"))).alias("lines"))
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    buyer = F.when(k == 0, F.concat(F.lit('"c-'), c, F.lit('"'))).when(k == 1, F.concat(F.lit('{"id":'), c, F.lit("}"))).otherwise(c)
    rest = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 50 == 0, "n").alias("note"), "lines"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"buyer":'), buyer, F.lit(","), F.substring(rest, 2, 1 << 30)).alias("document"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS n FROM lineitem), b AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 AS k FROM orders)
    SELECT o_orderkey AS id, '/id' AS path, '/properties/id/minimum' AS schema_path, o_orderkey || ' is less than the minimum of 10' AS message FROM orders WHERE o_orderkey < 10
    UNION ALL SELECT o_orderkey, '/status', '/properties/status/enum', '''P'' is not one of ["O", "F"]' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, '/priority', '/properties/priority/pattern', '''' || o_orderpriority || ''' does not match ''^[1-3]-''' FROM orders WHERE substr(o_orderpriority, 1, 1) NOT IN ('1', '2', '3')
    UNION ALL SELECT id, '/buyer', '/properties/buyer/anyOf', CASE k WHEN 0 THEN '''c-' || c || '''' WHEN 1 THEN '{"id":' || c || '}' ELSE CAST(c AS VARCHAR) END || ' is not valid under any of the given schemas' FROM b WHERE k = 2 OR k = 1 AND c > 1000 OR k = 0 AND c > 999
    UNION ALL SELECT id, '/lines', '/properties/lines/maxItems', NULL FROM l GROUP BY id HAVING count(*) > 6
    UNION ALL SELECT id, '/lines/' || n || '/q', '/properties/lines/items/$ref/properties/q/maximum', NULL FROM l WHERE q > 45 AND id IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT o_orderkey, '', '/required', '''lines'' is a required property' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM l)
    UNION ALL SELECT o_orderkey, '', '/additionalProperties', 'Additional properties are not allowed (''note'' was unexpected)' FROM orders WHERE o_orderkey % 50 = 0"""
)
def schema_issues(spark, sf):
    """Every issue; messages that repeat whole lists or numbers of lines are left out."""
    found = V.issues(_documents(spark, sf), "id", "document", SCHEMA)
    return found.withColumn("message", F.when(~F.col("path").startswith("/lines"), F.col("message")))

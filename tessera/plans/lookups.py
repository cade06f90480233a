"""Look-ups, selections and names over the tables."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import lines as L
from tessera.operators.checkpoint import shared_folder
from tessera.plans.base import query, table
from tessera.plans.text import _QUALITY
from tessera.sources import embeddings, runs


@query(
    f"""WITH {_QUALITY} SELECT doc_id, count(*) AS lines, sum(CASE WHEN kind = 'keep' OR line_no % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS kept FROM gate GROUP BY doc_id"""
)
def protected_lines(spark, sf):
    """Every seventh line stays, whatever its grade; marks of lines that no text has count for nothing."""
    lines = L.explode_lines(table(spark, sf, "documents").select("doc_id", "text"))
    marks = lines.filter("line_no % 7 = 0").select("doc_id", F.explode(F.array("line_no", "line_no", F.lit(10_000_000).cast("long"))).alias("line_no"))
    graded = L.grade(lines).select("doc_id", "line_no", (F.col("quality.kind") == "keep").alias("keep"))  # the marks are joined to grades, not to texts
    return L.protect(graded, marks).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("keep") | F.col("is_protected")).alias("kept"))


@query(
    """WITH c AS (SELECT l_orderkey AS k, l_partkey AS id, min(l_linenumber * 1000000 + l_suppkey) AS place FROM lineitem GROUP BY ALL), f AS (SELECT id, min(k * 10000000 + place) AS place FROM c WHERE k % 10 = 0 GROUP BY id)
    SELECT id AS candidate_id, place AS position, p_name AS name FROM f JOIN part ON p_partkey = id"""
)
def selected_candidates(spark, sf):
    """Parts that orders ask for: each once, where it is asked for first; those that no table has are dropped."""
    asked = table(spark, sf, "lineitem").filter("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("candidate_id"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("position"))
    missing = asked.withColumn("candidate_id", F.col("candidate_id") + 1_000_000_000)
    known = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name"))
    return E.select_by_ids(asked.union(missing), known).select("candidate_id", "position", "name")


@query(
    """WITH t AS (SELECT event_id, event_type AS a, CASE event_id % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'sample_signal' WHEN 2 THEN 'value' ELSE 'other_signal' END AS c, CASE event_id % 3 WHEN 0 THEN 'method_signal' WHEN 1 THEN 'context' ELSE 'relation' END AS r FROM events)
    SELECT event_id, CASE WHEN c IN ('identity', 'value') AND r = 'method_signal' THEN r ELSE c END AS category, CASE WHEN c IN ('identity', 'value') AND r = 'method_signal' THEN c ELSE r END AS role FROM t"""
)
def repaired_roles(spark, sf):
    k = F.col("event_id")
    c = F.when(k % 4 == 0, "identity").when(k % 4 == 1, "sample_signal").when(k % 4 == 2, "value").otherwise("other_signal")
    r = F.when(k % 3 == 0, "method_signal").when(k % 3 == 1, "context").otherwise("relation")
    category, role = E.repair_swapped(c, r)
    return table(spark, sf, "events").select("event_id", category.alias("category"), role.alias("role"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS token, regexp_replace('(' || p_brand || '): ' || p_type || '?', '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped,
    array_to_string(list_filter([trim(p_name), CASE WHEN lower(trim(p_type)) <> lower(trim(p_name)) THEN trim(p_type) END], lambda x: x IS NOT NULL), ' ') AS title FROM part"""
)
def index_names(spark, sf):
    """Tokens for the names of indexes, escaped query texts, and titles whose parts stand once."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        T.index_token(F.concat("p_name", F.lit(" #"), "p_brand")).alias("token"),
        T.escape_query(F.concat(F.lit("("), "p_brand", F.lit("): "), "p_type", F.lit("?"))).alias("escaped"),
        T.ordered_distinct("p_name", F.upper("p_name"), F.lit("  "), "p_type", F.lower("p_type")).alias("title"),
    )


@query(
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, text IS NULL AS missing, CASE WHEN text IS NULL THEN NULL ELSE array_to_string([CAST(len(t) - len(replace(t, c, '')) AS VARCHAR) for c in ['a', 'e', 'i', 'o', 'u', 'n', 'r', 't']], ',') END AS vector FROM t JOIN documents USING (doc_id)"""
)
def embedded_texts(spark, sf):
    """Vectors of all texts through the cache, twice: the second run finds them all there."""
    docs, cache = table(spark, sf, "documents").select("doc_id", "text"), shared_folder(spark, "vectors")
    model = lambda texts: [[float(t.count(c)) for c in "aeiounrt"] for t in texts]
    embeddings.embed(docs, "doc_id", "text", model, cache)
    found = embeddings.embed(docs, "doc_id", "text", model, cache).join(docs, "doc_id")
    return found.select("doc_id", F.col("text").isNull().alias("missing"), F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@query(
    """WITH e AS (SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, event_id FROM e WHERE user_id % 3 <> 1"""
)
def run_look_up(spark, sf):
    """The last event of each user and type, merged in two batches, and looked up by key in the buckets of the keys asked for."""
    e, at = table(spark, sf, "events").select("user_id", "event_type", "event_id"), shared_folder(spark, "runs")
    keys = ["user_id", "event_type"]
    for part in (0, 1):
        runs.merge(spark, at, e.filter(F.col("event_id") % 2 == part) if part == 0 else e, keys, latest="event_id")
    return runs.look_up(spark, at, e.filter("user_id % 3 <> 1").select(*keys), keys)


@query(
    """WITH t AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS o FROM orders UNION SELECT 'l' || l_orderkey, 'p' || l_partkey FROM lineitem) SELECT s, o FROM t"""
)
def distinct_edges(spark, sf):
    """Triples that repeat are one edge; literals and types are none."""
    line = table(spark, sf, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("o"))
    order = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("s"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("o"))
    rows = line.union(line).union(order).withColumns({"p": F.lit("has"), "o_kind": F.lit("iri")})
    return G.to_edges(rows.unionByName(rows.withColumn("o_kind", F.lit("literal"))).unionByName(rows.withColumn("p", F.lit(G.RDF_TYPE)))).select("s", "o")

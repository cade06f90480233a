"""Vocabulary and retrieval queries over a graph made of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS, WORD
from tessera.operators import fulltext as X
from tessera.operators import graph as G
from tessera.operators import search as S
from tessera.plans.base import query, table

QUERY, TOP = "the of and for with licensed", 20
_VEC = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
 v AS (SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q),
 vt AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v ORDER BY score DESC, id LIMIT 20)"""
_BM25 = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean FROM w),
 p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM w) WHERE term IN ('the','of','and','for','with','licensed') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 b AS (SELECT p.id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))), 6) AS score FROM p JOIN df ON p.term = df.term JOIN w ON p.id = w.id, st GROUP BY p.id),
 ft AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b ORDER BY score DESC, id LIMIT 20)"""


def _first_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


@query(f"WITH {_VEC} SELECT id, score, CAST(rank AS INTEGER) AS rank FROM vt")
def vector_topk(spark, sf):
    return S.vector_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), TOP)


@query(f"WITH {_BM25} SELECT id, score, CAST(rank AS INTEGER) AS rank FROM ft")
def fulltext_bm25_topk(spark, sf):
    return S.full_text_top_k(table(spark, sf, "documents"), "doc_id", "text", QUERY, TOP)


@query(
    f"WITH {_VEC}, {_BM25}, u AS (SELECT coalesce(vt.id, ft.id) AS id, vt.score AS vector_score, CAST(vt.rank AS INTEGER) AS vector_rank, ft.score AS full_text_score, CAST(ft.rank AS INTEGER) AS full_text_rank,"
    " round(coalesce(1.0 / (60 + vt.rank), 0) + coalesce(3.0 / (60 + ft.rank), 0), 9) AS rrf_score FROM vt FULL JOIN ft ON vt.id = ft.id)"
    " SELECT id, vector_score, vector_rank, full_text_score, full_text_rank, CAST(rrf_score AS DOUBLE) AS rrf_score FROM u ORDER BY rrf_score DESC, least(vector_rank, full_text_rank), id LIMIT 20"
)
def rrf_hybrid_search(spark, sf):
    return S.rrf(vector_topk(spark, sf), fulltext_bm25_topk(spark, sf), TOP, 1.0, 3.0)


#: positions of words (from 0) in documents, and lengths without stop words; ``f`` holds the word forms of the queries below by stem
_WORDS = f"""d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '{WORD.replace("'", "''")}'), lambda w: regexp_replace(w, '[''’]s$', '')) AS ws FROM documents),
    f(w, s) AS (VALUES ('oning', 'on'), ('oned', 'on'), ('ones', 'on'), ('one', 'on'), ('shing', 'shing'), ('shinged', 'shing'), ('shinges', 'shing'), ('shinging', 'shing'), ('shings', 'shing'), ('shed', 'shed'), ('sheds', 'shed'), ('tion', 'tion'), ('tions', 'tion'), ('tiones', 'tion'), ('tioned', 'tion'), ('tioning', 'tion')),
    w AS (SELECT id, i - 1 AS pos, ws[i] AS w FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
    k AS (SELECT id, pos, w FROM w WHERE w NOT IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})),
    p AS (SELECT id, pos, s FROM k JOIN f USING (w)),
    l AS (SELECT d.id, count(k.id) AS n FROM d LEFT JOIN k ON k.id = d.id GROUP BY d.id), z AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
    nd AS (SELECT s, count(DISTINCT id) AS df FROM p GROUP BY s), idf AS (SELECT s, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM nd, z)"""
_TF = "{n} / ({n} + 1.2 * (0.25 + 0.75 * l.n / z.mean))"


@query(
    f"""WITH {_WORDS}, h AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON a.s = 'tion' AND b.s = 'on' AND b.id = a.id AND b.pos = a.pos + 2 GROUP BY a.id)
    SELECT h.id, round((SELECT sum(idf) FROM idf WHERE s IN ('tion', 'on')) * {_TF.format(n="h.n")}, 6) AS score FROM h JOIN l ON l.id = h.id, z"""
)
def fulltext_phrase(spark, sf):
    """Two words with any one word between them, in all their forms."""
    q = X.Phrase("tion the oning")
    return X.matches(*X.postings(table(spark, sf, "documents"), "doc_id", "text", q), q)


@query(
    f"""WITH {_WORDS}, t AS (SELECT id, s, count(*) AS n FROM p GROUP BY id, s), x AS (SELECT DISTINCT id FROM k WHERE w LIKE 'thbl%'), h AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.s = 'shing' AND b.s = 'tion' AND b.id = a.id AND b.pos = a.pos + 1),
    m AS (SELECT o.id, idf.idf * {_TF.format(n="o.n")} + CASE WHEN x.id IS NOT NULL THEN 1.0 ELSE 0 END + coalesce((SELECT any_value(idf) FROM idf WHERE s = 'shed') * {_TF.format(n="e.n")}, 0) AS score
      FROM t o JOIN idf ON o.s = 'on' AND idf.s = 'on' JOIN l ON l.id = o.id LEFT JOIN x ON x.id = o.id LEFT JOIN t e ON e.s = 'shed' AND e.id = o.id ANTI JOIN h ON h.id = o.id, z WHERE x.id IS NOT NULL OR e.id IS NOT NULL)
    SELECT id, round(score, 6) AS score FROM m"""
)
def fulltext_boolean(spark, sf):
    """A term and one of a prefix and another term, without a phrase."""
    q = X.Term("ones") & (X.Prefix("thbl") | X.Term("sheds")) & ~X.Phrase("shing tions")
    return X.matches(*X.postings(table(spark, sf, "documents"), "doc_id", "text", q), q)


_MEMBERS = "members AS (SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id % 2 = 0)"


def _members_of_scheme(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en' AND doc_id % 2 = 0").select(F.col("doc_id").alias("id"))


@query(
    f"""WITH {_VEC}, {_WORDS}, {_MEMBERS}, t AS (SELECT id, s, count(*) AS n FROM p WHERE s IN ('on', 'tion') GROUP BY id, s), g AS (SELECT t.id, round(sum(idf.idf * {_TF.format(n="t.n")}), 6) AS score FROM t JOIN idf USING (s) JOIN l ON l.id = t.id, z GROUP BY t.id),
    g20 AS (SELECT * FROM g ORDER BY score DESC, id LIMIT {TOP}), fm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM g20 SEMI JOIN members USING (id)),
    vm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vt SEMI JOIN members USING (id)),
    u AS (SELECT coalesce(vm.id, fm.id) AS id, CAST(vm.rank AS INTEGER) AS vector_rank, CAST(fm.rank AS INTEGER) AS full_text_rank, round(coalesce(1.0 / (60 + vm.rank), 0) + coalesce(3.0 / (60 + fm.rank), 0), 9) AS rrf_score FROM vm FULL JOIN fm ON vm.id = fm.id)
    SELECT id, vector_rank, full_text_rank, CAST(rrf_score AS DOUBLE) AS rrf_score FROM u"""
)
def scheme_hybrid_search(spark, sf):
    """Both ranked lists restricted to the members of one scheme after their limits, then fused."""
    members = _members_of_scheme(spark, sf)
    vector = S.vector_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), TOP, members)
    text = X.search(table(spark, sf, "documents"), "doc_id", "text", X.Term("ones tion"), TOP, members)
    return S.rrf(vector, text, TOP, 1.0, 3.0).select("id", "vector_rank", "full_text_rank", "rrf_score")


# ---------------------------------------------------------------- a graph of the star schema

_NODES = """nodes AS (SELECT 'customer/' || c_custkey AS uri, 'Customer' AS t, ['name', 'segment'] AS keys FROM customer UNION ALL SELECT 'order/' || o_orderkey, 'Order', ['status'] FROM orders UNION ALL SELECT 'nation/' || n_nationkey, 'Nation', ['name'] FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'Region', ['name'] FROM region UNION ALL SELECT 'supplier/' || s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 'Supplier' END, ['name'] FROM supplier)"""
_EDGES = """edges AS (SELECT 'order/' || o_orderkey AS s, 'placedBy' AS p, 'customer/' || o_custkey AS o FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'livesIn', 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'basedIn', 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'partOf', 'region/' || n_regionkey FROM nation)"""


def nodes(spark, sf):
    def part(name, prefix, key, kind, props):
        t = table(spark, sf, name)
        entries = F.create_map(*(x for k, c in props.items() for x in (F.lit(k), F.array(F.col(c)))))
        return t.select(F.concat(F.lit(prefix + "/"), F.col(key).cast("string")).alias("uri"), F.array_compact(F.array(kind)).alias("rdf_types"), entries.alias("properties"))

    return (
        part("customer", "customer", "c_custkey", F.lit("Customer"), {"name": "c_name", "segment": "c_mktsegment"})
        .union(part("orders", "order", "o_orderkey", F.lit("Order"), {"status": "o_orderstatus"}))
        .union(part("nation", "nation", "n_nationkey", F.lit("Nation"), {"name": "n_name"}))
        .union(part("region", "region", "r_regionkey", F.lit("Region"), {"name": "r_name"}))
        .union(part("supplier", "supplier", "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.lit("Supplier")), {"name": "s_name"}))
    )


def edges(spark, sf):
    def part(name, s, key, p, o, to):
        return table(spark, sf, name).select(F.concat(F.lit(s + "/"), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(o + "/"), F.col(to).cast("string")).alias("o"))

    return (
        part("orders", "order", "o_orderkey", "placedBy", "customer", "o_custkey")
        .union(part("customer", "customer", "c_custkey", "livesIn", "nation", "c_nationkey"))
        .union(part("supplier", "supplier", "s_suppkey", "basedIn", "nation", "s_nationkey"))
        .union(part("nation", "nation", "n_nationkey", "partOf", "region", "n_regionkey"))
    )


@query(
    f"WITH {_NODES}, {_EDGES}, c AS (SELECT t, count(DISTINCT uri) AS n FROM nodes WHERE t IS NOT NULL GROUP BY t), k AS (SELECT t, string_agg(DISTINCT key, ',' ORDER BY key) AS properties FROM (SELECT t, unnest(keys) AS key FROM nodes) GROUP BY t),"
    " r AS (SELECT t, string_agg(DISTINCT p, ',' ORDER BY p) AS relationships FROM nodes JOIN edges ON uri = s GROUP BY t) SELECT c.t AS rdf_type, n, properties, coalesce(relationships, '') AS relationships FROM c LEFT JOIN k ON c.t = k.t LEFT JOIN r ON c.t = r.t"
)
def graph_type_profile(spark, sf):
    p = G.type_profile(nodes(spark, sf), edges(spark, sf))
    return p.select("rdf_type", "n", F.array_join("properties", ",").alias("properties"), F.array_join("relationships", ",").alias("relationships"))


@query(f"WITH {_NODES} SELECT uri FROM nodes WHERE t IS NULL")
def untyped_cleanup(spark, sf):
    return G.untyped(nodes(spark, sf)).select("uri")


_MEMBERS = "m AS (SELECT DISTINCT 'cust' AS identifier, 'nation/' || c_nationkey AS uri FROM customer UNION SELECT 'supp', 'nation/' || s_nationkey FROM supplier WHERE s_nationkey % 3 = 0)"


@query(f"WITH {_MEMBERS} SELECT uri FROM m GROUP BY uri HAVING count(*) = 1 AND min(identifier) = 'cust'")
def exclusive_members(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("cust").alias("identifier"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("uri"))
    b = table(spark, sf, "supplier").filter("s_nationkey % 3 = 0").select(F.lit("supp").alias("identifier"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("uri"))
    return G.exclusive_members(a.union(b), "cust")


def _khop(steps: str, hops: int, seeds: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, st AS ({steps}), seeds AS ({seeds}), w AS (SELECT uri AS seed, uri AS at, 0 AS hop FROM seeds UNION SELECT w.seed, st.nxt, hop + 1 FROM w JOIN st ON w.at = st.at WHERE hop < {hops - 1}),
    f AS (SELECT DISTINCT seed, s, p, o FROM w JOIN st ON w.at = st.at), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY s, p, o) AS k FROM f) SELECT seed, s, p, o FROM k WHERE k <= 50"""


_OUT, _IN = "SELECT s AS at, o AS nxt, s, p, o FROM edges", "SELECT o AS at, s AS nxt, s, p, o FROM edges"


@query(_khop(_OUT, 3, "SELECT 'order/' || o_orderkey AS uri FROM orders"))
def khop_expand_out(spark, sf):
    seeds = table(spark, sf, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")))
    return G.expand(edges(spark, sf), seeds, 3, "out", limit=50)


@query(_khop(_IN, 3, "SELECT 'region/' || r_regionkey AS uri FROM region"))
def khop_expand_in(spark, sf):
    return G.expand(edges(spark, sf), table(spark, sf, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string"))), 3, "in", limit=50)


@query(_khop(f"{_OUT} UNION ALL {_IN}", 2, "SELECT 'nation/' || n_nationkey AS uri FROM nation"))
def khop_expand_undirected(spark, sf):
    return G.expand(edges(spark, sf), table(spark, sf, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"))), 2, "both", limit=50)


@query(
    f"""WITH {_EDGES}, l AS (SELECT 'nation/' || n_nationkey AS uri, n_name AS label FROM nation UNION ALL SELECT 'region/' || r_regionkey, r_name FROM region UNION ALL SELECT 'supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer/' || c_custkey, c_name FROM customer),
    b AS (SELECT s AS uri, p AS relation, o AS other FROM edges UNION ALL SELECT o, p, s FROM edges), r AS (SELECT DISTINCT b.uri, relation, label FROM b JOIN l ON other = l.uri), k AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY relation, label) AS k FROM r) SELECT uri, relation, label FROM k WHERE k <= 6"""
)
def related_terms(spark, sf):
    return G.related_terms(edges(spark, sf), nodes(spark, sf), "name")


@query(
    f"WITH {_NODES} SELECT uri, list_last(string_split(uri, '/')) AS local, coalesce(t, '') AS rdf_type FROM nodes"
)
def candidate_titles(spark, sf):
    n = nodes(spark, sf)
    made = G.candidate_records(n, ["label"], ["definition"], ["name"])
    return made.join(n, "uri").select("uri", F.col("title").alias("local"), F.array_join("rdf_types", ",").alias("rdf_type"))


@query(
    "WITH f AS (SELECT label AS batch_of, vec_id AS uri FROM embeddings WHERE vec_id % 3 = 0) SELECT uri, CAST((row_number() OVER (ORDER BY uri) - 1) // 32 AS BIGINT) AS batch FROM f"
)
def pending_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("uri"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return G.pending_embeddings(e)

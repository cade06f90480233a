"""RDF vocabularies as node and edge tables: import, clean-up, profile, expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
GENID = "http://example.org/.well-known/genid/"


def parse_ntriples(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(s, p, o, o_kind, o_lang, o_datatype) of N-Triples lines; comments, blank and malformed lines give none."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    g = lambda k: F.regexp_extract(F.col(line_col), pattern, k)
    unquoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(g(5), r"\\n", "\n"), r"\\t", "\t"), r'\\"', '"'), r"\\\\", r"\\")
    kind = F.when(g(3) != "", "iri").when(g(4) != "", "bnode").otherwise("literal")
    subject = F.regexp_replace(g(1), "^<|>$", "")
    return lines.filter(F.col(line_col).rlike(pattern)).select(
        subject.alias("s"), g(2).alias("p"), F.when(kind == "iri", g(3)).when(kind == "bnode", g(4)).otherwise(unquoted).alias("o"),
        kind.alias("o_kind"), F.nullif(g(6), F.lit("")).alias("o_lang"), F.nullif(g(7), F.lit("")).alias("o_datatype"),
    )


def skolemise(triples: DataFrame, base: str = GENID) -> DataFrame:
    """Blank nodes under names made of their labels."""
    name = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit(base), F.substring(F.sha2(F.expr(f"substring({c}, 3)"), 256), 1, 8))).otherwise(F.col(c))
    o = F.when(F.col("o_kind") == "bnode", name("o")).otherwise(F.col("o"))
    return triples.withColumn("s", name("s")).withColumn("o", o).withColumn("o_kind", F.when(F.col("o_kind") == "bnode", "iri").otherwise(F.col("o_kind")))


def english_or_untagged(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("o_lang").isNull() | (F.lower("o_lang") == "en"))


def shorten_iri(c: Column, prefixes: Mapping[str, str]) -> Column:
    """``prefix__local`` by the longest namespace that fits; unknown ones stay."""
    out = c
    for prefix, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(c.startswith(space), F.concat(F.lit(prefix + "__"), F.substring(c, F.lit(len(space) + 1), F.length(c)))).otherwise(out)
    return out


def to_nodes(triples: DataFrame) -> DataFrame:
    """(uri, rdf_types, properties: map of sorted distinct values) of all subjects."""
    literals = triples.filter("o_kind = 'literal'").groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("v")).groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("properties"))
    types = triples.filter(F.col("p") == RDF_TYPE).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("rdf_types"))
    empty = F.create_map().cast("map<string,array<string>>")
    return triples.select("s").distinct().join(types, "s", "left").join(literals, "s", "left").select(F.col("s").alias("uri"), F.coalesce("rdf_types", F.array().cast("array<string>")).alias("rdf_types"), F.coalesce("properties", empty).alias("properties"))


def to_edges(triples: DataFrame) -> DataFrame:
    return triples.filter((F.col("o_kind") == "iri") & (F.col("p") != RDF_TYPE)).select("s", "p", "o").distinct()


def type_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type: relationship types that leave its nodes, property keys, number of nodes."""
    typed = nodes.select("uri", F.explode("rdf_types").alias("rdf_type"), F.map_keys("properties").alias("keys"))
    counts = typed.groupBy("rdf_type").agg(F.count_distinct("uri").alias("n"))
    keys = typed.select("rdf_type", F.explode("keys").alias("key")).groupBy("rdf_type").agg(F.array_sort(F.collect_set("key")).alias("properties"))
    rel = typed.join(edges, typed.uri == edges.s).groupBy("rdf_type").agg(F.array_sort(F.collect_set("p")).alias("relationships"))
    none = F.array().cast("array<string>")
    return counts.join(keys, "rdf_type", "left").join(rel, "rdf_type", "left").select("rdf_type", "n", F.coalesce("properties", none).alias("properties"), F.coalesce("relationships", none).alias("relationships"))


def untyped(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.size("rdf_types") == 0)


def remove_untyped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = untyped(nodes).select("uri")
    kept = edges.join(gone, edges.s == gone.uri, "left_anti")
    return nodes.join(gone, "uri", "left_anti"), kept.join(gone, kept.o == gone.uri, "left_anti")


def exclusive_members(membership: DataFrame, vocabulary: str) -> DataFrame:
    """Nodes of ``vocabulary`` that no other vocabulary has: what its deletion removes."""
    n = membership.dropDuplicates(["identifier", "uri"]).groupBy("uri").agg(F.count("*").alias("n"), F.min("identifier").alias("identifier"))
    return n.filter((F.col("n") == 1) & (F.col("identifier") == vocabulary)).select("uri")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", predicates: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(seed, s, p, o) of the edges on paths of at most ``hops`` edges from each seed, at most ``limit`` a seed in order of s, p, o.

    Breadth first: every hop joins the frontier to the edges and drops (seed,
    node) pairs reached before, so cycles end and each pair is expanded once.
    """
    from tessera.operators.checkpoint import cut

    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    e = edges if predicates is None else edges.filter(F.col("p").isin(*predicates))
    out = e.select(F.col("s").alias("at"), F.col("o").alias("to"), "s", "p", "o")
    into = e.select(F.col("o").alias("at"), F.col("s").alias("to"), "s", "p", "o")
    steps = {"out": out, "in": into, "both": out.union(into)}[direction]
    frontier = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().select("seed", F.col("seed").alias("at"))
    seen, found = frontier, None
    for hop in range(hops):
        taken = frontier.join(steps, "at").select("seed", "to", "s", "p", "o")
        found = taken if found is None else found.union(taken)
        if hop + 1 < hops:
            frontier = cut(taken.select("seed", F.col("to").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti"))
            seen = seen.union(frontier)
    if found is None:
        return frontier.limit(0).select("seed", F.lit("").alias("s"), F.lit("").alias("p"), F.lit("").alias("o"))
    found = found.select("seed", "s", "p", "o")
    if limit is not None:  # a dense rank counts repeated edges once, and every task keeps only the first ranks of a seed before the shuffle
        found = found.withColumn("__k", F.dense_rank().over(Window.partitionBy("seed").orderBy("s", "p", "o"))).filter(F.col("__k") <= limit).drop("__k")
    return found.distinct()


def related_terms(edges: DataFrame, nodes: DataFrame, label_key: str, limit: int = 6, skip: Sequence[str] = ("narrower",)) -> DataFrame:
    """(uri, relation, label) of neighbours on either side, at most ``limit`` a node.

    A sub-class edge reads as ``broader`` from its subject and ``narrower`` from its object.
    """
    labels = nodes.select(F.col("uri").alias("other"), F.array_min(F.col("properties")[label_key]).alias("label")).filter("label is not null")
    local = F.element_at(F.split("p", r"[#/]|__"), -1)
    flip = F.when(local == "broader", "narrower").when(local == "narrower", "broader").when(local == "subClassOf", "narrower").otherwise(local)
    ahead = edges.select(F.col("s").alias("uri"), F.when(local == "subClassOf", "broader").otherwise(local).alias("relation"), F.col("o").alias("other"))
    back = edges.select(F.col("o").alias("uri"), flip.alias("relation"), F.col("s").alias("other"))
    both = ahead.union(back).filter(~F.col("relation").isin(*skip)).join(labels, "other").select("uri", "relation", "label").distinct()
    return both.withColumn("__k", F.row_number().over(Window.partitionBy("uri").orderBy("relation", "label"))).filter(F.col("__k") <= limit).drop("__k")


def upsert_embeddings(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` (uri, …, embedding) with the embeddings of ``new`` (uri, embedding) where it has one."""
    fresh = new.dropDuplicates(["uri"]).select("uri", F.col("embedding").alias("__new"))
    return nodes.join(fresh, "uri", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new")


def pending_embeddings(nodes: DataFrame, batch: int = 32) -> DataFrame:
    """Nodes without an embedding, with the number of the batch that will fetch it."""
    from tessera.operators.ranking import global_rank

    return global_rank(nodes.filter("embedding is null").select("uri"), F.col("uri")).withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("long")).drop("rank")


#: Types that describe a vocabulary as a whole.
DESCRIPTION_TYPES = (
    "http://www.w3.org/2004/02/skos/core#ConceptScheme",
    "http://www.w3.org/2002/07/owl#Ontology",
    "http://www.w3.org/ns/dcat#Dataset",
    "http://rdfs.org/ns/void#Dataset",
    "http://purl.org/dc/dcmitype/Dataset",
)


def description_triples(triples: DataFrame, types: Sequence[str] = DESCRIPTION_TYPES) -> DataFrame:
    roots = triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(*types)).select("s").distinct()
    return triples.join(roots, "s", "left_semi")


def to_turtle(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """One Turtle statement block (subject, turtle) for each chosen subject."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(quoted, tail)).when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.col("o"))
    own = triples.join(subjects.select(F.col(subjects.columns[0]).alias("s")).distinct(), "s", "left_semi")
    parts = own.select("s", F.concat(F.lit("<"), "p", F.lit("> "), obj).alias("po")).groupBy("s").agg(F.array_sort(F.collect_set("po")).alias("po"))
    return parts.select(F.col("s").alias("subject"), F.concat(F.lit("<"), "s", F.lit("> "), F.array_join("po", " ;\n    "), F.lit(" .")).alias("turtle"))


def candidate_records(nodes: DataFrame, title_keys: Sequence[str], definition_keys: Sequence[str], synonym_keys: Sequence[str], limit: int = 5, width: int = 300) -> DataFrame:
    """(uri, title, definition, synonyms): the first property in order that has a value; blank nodes are left out."""
    first = lambda keys: F.coalesce(*(F.element_at(F.array_sort(F.col("properties")[k]), 1) for k in keys), F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.coalesce(F.col("properties")[k], none) for k in synonym_keys)))
    title = F.coalesce(first(title_keys), F.element_at(F.split("uri", r"[#/]"), -1))
    return nodes.filter(~F.col("uri").contains("/.well-known/genid/")).select(
        "uri", title.alias("title"), F.substring(first(definition_keys), 1, width).alias("definition"), F.slice(F.array_except(F.array_distinct(every), F.array(title)), 1, limit).alias("synonyms")
    )


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(uri, text): the properties in order of their keys, as one line a value."""
    entries = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("k"), F.array_join(F.array_sort(e["value"]), ", ").alias("v"))))
    return nodes.select("uri", F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "\n").alias("text"))


#: Types of a vocabulary's own machinery, by name.
META_TYPES = ("Ontology", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Restriction", "Class", "Property", "ConceptScheme")


def import_membership(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(identifier, uri): resources of vocabularies that are nodes, each once."""
    # the members are looked up, so that the nodes, which are more, needn't be sorted
    return nodes.select("uri").join(members.select("identifier", "uri").distinct().hint("shuffle_hash"), "uri").select("identifier", "uri").distinct()


def resources_of(membership: DataFrame) -> DataFrame:
    """(identifier, position, uri): the distinct resources of each vocabulary, numbered from 1 by uri. A row each, and ranked over all tasks, so a vocabulary may be of any size."""
    from tessera.operators.ranking import global_rank

    ranked = global_rank(membership.select("identifier", "uri").distinct(), F.col("identifier"), F.col("uri"), name="__rank")
    first = ranked.groupBy("identifier").agg(F.min("__rank").alias("__first")).withColumnRenamed("identifier", "__of")
    return ranked.join(first, F.col("identifier").eqNullSafe(F.col("__of"))).select("identifier", (F.col("__rank") - F.col("__first") + 1).alias("position"), "uri")


def scheme_profile(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(identifier, rdf_type, count, relationships): types of each vocabulary's nodes, and the types of edges at either end of them; nodes without edges count too."""
    # the members are the lesser side: they are looked up, while nodes and edges stream past them unsorted
    members = membership.distinct()
    typed = nodes.select("uri", F.explode("rdf_types").alias("rdf_type")).join(members.hint("shuffle_hash"), "uri").filter("identifier is not null and rdf_type is not null").select("identifier", "rdf_type", "uri").distinct()
    ends = edges.select(F.explode(F.array("s", "o")).alias("uri"), "p")
    kinds = ends.join(typed.hint("shuffle_hash"), "uri").groupBy("identifier", "rdf_type", "p").agg(F.count("*").alias("__n")).groupBy("identifier", "rdf_type").agg(F.array_sort(F.collect_list("p")).alias("relationships"))
    counts = typed.groupBy("identifier", "rdf_type").agg(F.count("*").alias("count"))
    return counts.join(kinds, ["identifier", "rdf_type"], "left").withColumn("relationships", F.coalesce("relationships", F.array().cast("array<string>")))


def fetch_resources(nodes: DataFrame, uris: DataFrame, meta: Sequence[str] = META_TYPES) -> DataFrame:
    """Nodes of a set of uris with their types but the ``meta`` ones; nodes of meta types alone are left out."""
    kept = F.filter("rdf_types", lambda t: ~t.isin(*meta))
    return nodes.join(uris.select(F.col(uris.columns[0]).alias("uri")).distinct(), "uri", "left_semi").withColumn("rdf_types", kept).filter(F.size("rdf_types") > 0)


def endpoint_uris(seeds: DataFrame, statements: DataFrame) -> DataFrame:
    """(uri): seeds and both ends of statements (s, o), each once."""
    return seeds.select(F.col(seeds.columns[0]).alias("uri")).union(statements.select("s")).union(statements.select("o")).distinct()


def graph_counts(triples: DataFrame) -> DataFrame:
    """One row: distinct triples and distinct named resources among their ends."""
    t = triples.select("s", "p", "o", "o_kind").distinct()
    ends = t.select(F.col("s").alias("r")).union(t.filter("o_kind = 'iri'").select("o")).filter(~F.col("r").startswith("_:")).distinct()
    return t.agg(F.count("*").alias("n_triples")).crossJoin(ends.agg(F.count("*").alias("n_resources")))  # a row by a row


def backup(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables under ``path``, replacing what is there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def restore(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")

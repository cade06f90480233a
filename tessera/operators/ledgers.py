"""Field ledgers, requirement reports, scored branches and attribute decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.reports import run_matrix


def field_ledger(paths: DataFrame, generated: DataFrame, curated: DataFrame, evidence: DataFrame, errors: DataFrame, keys: Sequence[str] = ("id", "pointer")) -> DataFrame:
    """One row for each path: both values, number of evidence rows and of errors, and its status."""
    k = list(keys)
    g, c = generated.select(*k, F.col("value").alias("generated")), curated.select(*k, F.col("value").alias("curated"))
    count = lambda df, name: df.groupBy(*k).agg(F.count("*").alias(name))
    every = paths.select(*k).union(g.select(*k)).union(c.select(*k)).distinct()
    joined = every.join(g, k, "left").join(c, k, "left").join(count(evidence, "n_evidence"), k, "left").join(count(errors, "n_errors"), k, "left").na.fill(0, ["n_evidence", "n_errors"])
    status = F.when(F.col("n_errors") > 0, "invalid").when(F.col("curated").isNull() & F.col("generated").isNull(), "missing").when(F.col("curated").isNull(), "removed").when(F.col("generated").isNull(), "added").when(F.col("generated") != F.col("curated"), "modified").otherwise("unchanged")
    return joined.withColumn("status", status)


#: Quality of a requirement's status.
STATUS_QUALITY = {"fulfilled": 1.0, "partial": 0.5}


def requirement_report(requirements: DataFrame, assessments: DataFrame) -> DataFrame:
    """Requirements with status, quality and weighted score; of repeated assessments the first by ``position`` counts, missing ones are ``missing``."""
    first = assessments.groupBy("requirement_id").agg(F.min_by("status", "position").alias("status"))
    joined = requirements.join(first, "requirement_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    quality = F.lit(0.0)
    for name, q in STATUS_QUALITY.items():
        quality = F.when(F.col("status") == name, q).otherwise(quality)
    return joined.withColumn("quality", quality).withColumn("weighted_score", F.round(F.col("quality") * F.col("weight"), 6))


def path_coverage(requirements: DataFrame, leaves: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, requirement_id, satisfied): whether any target path of a requirement has a value in the document, itself or below.

    Requirements' paths are joined to the prefixes of the leaves, so only matching pairs come about. A
    document's hits and a mark of its own are dealt out by id once (to ``tasks`` tasks, where given); there it gets every requirement,
    and nothing is joined by id.
    """
    empty = F.coalesce(F.col("value").isin('""', "null", "[]", "{}"), F.lit(True))
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("pointer", "/"))), lambda n: F.array_join(F.slice(F.split("pointer", "/"), 1, n), "/"))
    targets = requirements.select("requirement_id", F.explode("target_paths").alias("p")).select("requirement_id", F.regexp_replace("p", "/-$", "").alias("path"))
    mark = F.array(F.lit(None).cast("string"))
    marked = leaves.select("id", F.explode(F.when(empty, mark).otherwise(F.concat(mark, up))).alias("path"))
    met = marked.join(targets.filter("path is not null"), "path", "left").filter("path is null or requirement_id is not null").select("id", "requirement_id", F.col("path").isNotNull().alias("hit"))
    met = (met.repartition(tasks, "id") if tasks else met.repartition("id")).distinct()
    every = run_matrix(met.filter("not hit").select("id"), requirements.select("requirement_id").distinct()).withColumn("hit", F.lit(False))
    return every.unionByName(met.filter("hit")).groupBy("id", "requirement_id").agg(F.max("hit").alias("satisfied"))


def ancestor_labels(leaves: DataFrame, label_names: Sequence[str] = ("title", "label", "name"), limit: int = 500) -> DataFrame:
    """(id, pointer, context): labels that stand beside a leaf or above it, nearest last, each once, at most ``limit`` characters.

    A document's leaves meet in one pass, sorted by pointer: nothing is joined or broadcast.
    """
    label = F.when(F.element_at(F.split("pointer", "/"), -1).isin(*label_names), F.struct(F.regexp_replace("pointer", "/[^/]*$", "").alias("above"), F.regexp_replace("value", '^"|"$', "").alias("label")))
    own = leaves.filter("id is not null and pointer is not null").select("id", "pointer", label.alias("__label"))
    document = Window.partitionBy("id").orderBy("pointer")
    whole = document.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = own.withColumn("__again", F.lag("pointer").over(document).eqNullSafe(F.col("pointer"))).withColumn("__labels", F.collect_list("__label").over(whole))
    over = F.filter("__labels", lambda x: F.startswith(F.col("pointer"), F.concat(x["above"], F.lit("/"))) | ((F.col("pointer") == "") & (x["above"] == "")))
    named = seen.filter("not __again and size(__labels) > 0").select("id", "pointer", F.array_sort(F.array_distinct(F.transform(over, lambda x: F.struct(F.length(x["above"]).alias("n"), x["label"].alias("label"))))).alias("x"))
    return named.filter(F.size("x") > 0).select("id", "pointer", F.substring(F.array_join(F.array_distinct(F.transform("x", lambda r: r["label"])), " > "), 1, limit).alias("context"))


def decompose_ranges(df: DataFrame, title: str, value: str) -> DataFrame:
    """Attributes whose value reads ``a to b`` become a minimum and a maximum; others stay."""
    bounds = T.range_bounds(value)
    one = F.array(F.struct(F.col(title).alias("t"), F.col(value).alias("v")))
    two = F.array(F.struct(F.concat(title, F.lit(" minimum")).alias("t"), bounds["low"].cast("string").alias("v")), F.struct(F.concat(title, F.lit(" maximum")).alias("t"), bounds["high"].cast("string").alias("v")))
    rest = [c for c in df.columns if c not in (title, value)]
    return df.select(*rest, F.explode(F.when(bounds.isNotNull(), two).otherwise(one)).alias("x")).select(*rest, F.col("x.t").alias(title), F.col("x.v").alias(value))


def same_value(a: Column, b: Column, rel: float = 1e-6, absolute: float = 1e-9) -> Column:
    """Numbers within a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def score_branches(branches: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, branch_id, score, position): shared words of queries and branches, at most ``limit`` branches a query; ties keep the branches' order."""
    b = branches.select("branch_id", F.explode(T.query_terms("text")).alias("term"))
    q = queries.select("query_id", F.explode(T.query_terms("text")).alias("term"))
    hit = q.join(b, "term").groupBy("query_id", "branch_id").agg(F.count("*").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch_id")
    return hit.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def branch_index(slots: DataFrame, roots: Sequence[str], depth: int = 3) -> DataFrame:
    """(root, path, class, depth) of schema branches: slots (class, slot, range) walked from the roots; repeated paths stand once.

    A schema has a few hundred slots, and the depth is bounded by the parameter.
    """
    now = slots.filter(F.col("class").isin(*roots)).select(F.col("class").alias("root"), F.concat(F.lit("/"), "slot").alias("path"), F.col("range").alias("class"), F.lit(1).alias("depth"))
    out = now
    for d in range(2, depth + 1):
        nxt = slots.select(F.col("class").alias("__c"), F.col("slot").alias("__s"), F.col("range").alias("__r"))
        now = now.join(nxt, now["class"] == nxt["__c"]).select("root", F.concat("path", F.lit("/"), "__s").alias("path"), F.col("__r").alias("class"), F.lit(d).alias("depth"))
        out = out.union(now)
    return out.distinct()


def query_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ledger rows (query_id, result_ids, selected_ids) after an upsert by query, with the ids that weren't selected."""
    merged = old.join(new.select("query_id").distinct(), "query_id", "left_anti").unionByName(new)
    return merged.withColumn("rejected_ids", F.array_except("result_ids", "selected_ids"))


def rank_branches(branches: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, branch_id, score, position): branches (branch_id, slot, range_class, depth, recommended, text) of a schema for queries (query_id, text, hints), by shared words and the hints' points, those above 0, at most ``limit``.

    Ties keep the order of the branches.
    """
    from tessera.operators.placement import branch_points

    every = run_matrix(queries, branches.select("branch_id", "slot", "range_class", "depth", "recommended", F.col("text").alias("__text")))
    shared = F.size(F.array_intersect(F.array_distinct(T.query_terms("text")), T.query_terms("__text")))
    scored = every.withColumn("score", branch_points(F.col("hints"), F.col("slot"), F.col("range_class"), F.col("depth"), F.col("recommended"), shared)).filter("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch_id")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("query_id", "branch_id", "score", "position")

"""What is chosen, in which order, and how much of it: files, values, routes, evidence, sections, steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.checkpoint import cut

#: Files shown of a package, lines of each, characters of a line.
TOP_FILES, PREVIEW_LINES, LINE_CHARS, NEIGHBOURS = 16, 80, 500, 4
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
#: Fields that a vocabulary enriches where a profile names none.
ENRICHABLE = ("type", "has_quantity_type", "unit")
METHOD_CUE = r"\b(method|procedure|protocol|plan|sampling|acquisition)\b"


def valid_identifier(c: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens, the first a letter or digit."""
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def enrichable_fields(slots: Column, requested: Column | None = None) -> Column:
    """The requested (or usual) fields that are among the slots, sorted."""
    wanted = requested if requested is not None else F.array(*map(F.lit, ENRICHABLE))
    return F.array_sort(F.array_intersect(F.array_distinct(wanted), slots))


def candidate_allowed(allowed: Column, category: Column, target: Column, role: Column, text: Column) -> Column:
    """Whether evidence may serve a requirement: no categories are named, its own is, or it is a parameter of a quantity or speaks of a method."""
    cue = (target == "Plan") & F.lower(text).rlike(METHOD_CUE)
    return (F.size(allowed) == 0) | F.array_contains(allowed, category) | ((target == "QuantitativeAttribute") & (role == "parameter")) | cue


def compact_distinct(values: Column, limit: int | None = None) -> Column:
    """The values in single spaces, each (but for case) once, where it came first, at most ``limit``."""
    clean = F.filter(F.transform(values, lambda v: T.strip(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    pairs = F.transform(clean, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))
    first = F.aggregate(
        pairs,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.when(F.array_contains(acc["keys"], x["k"]), acc).otherwise(F.struct(F.array_append(acc["keys"], x["k"]).alias("keys"), F.array_append(acc["kept"], x["v"]).alias("kept"))),
        lambda acc: acc["kept"],
    )
    return first if limit is None else F.slice(first, 1, limit)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def still_valid(sources: Column, ranked: Column) -> Column:
    """Whether the ranked paths among ``sources`` are the first ones of the ranking, in its order."""
    known = F.filter(sources, lambda p: F.array_contains(ranked, p))
    return (F.size(sources) > 0) & (known == F.slice(ranked, 1, F.greatest(F.size(known), F.lit(0))))


def top_files(files: DataFrame, package: str, rank: str, limit: int = TOP_FILES) -> DataFrame:
    """The best-ranked files of each package; a task passes on at most ``limit`` of a package."""
    return files.withColumn("__k", F.row_number().over(Window.partitionBy(package).orderBy(rank))).filter(F.col("__k") <= limit).drop("__k")


def preview(text: Column, lines: int = PREVIEW_LINES, chars: int = LINE_CHARS) -> Column:
    """The first lines of a text, long ones cut with three dots."""
    short = lambda s: F.when(F.length(s) <= chars, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, chars - 3)), F.lit("...")))
    return F.transform(F.slice(F.split(text, r"\r\n|\n|\r"), 1, lines), short)


def within_budget(sections: DataFrame, keys: Sequence[str], order: str, text: str, budget: int) -> DataFrame:
    """Sections in order as long as their estimated tokens fit the budget together, from the first that fits it alone; what comes after the first that doesn't is left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sections.withColumn("tokens", T.estimated_tokens(text))
    begun = F.bool_or(F.col("tokens") <= budget).over(w)
    used = sized.withColumn("__begun", begun).withColumn("used", F.sum(F.when(F.col("__begun"), F.col("tokens")).otherwise(0)).over(w))
    return used.filter(F.col("__begun") & (F.col("used") <= budget)).drop("__begun")


def neighbourhood(edges: DataFrame, nodes: DataFrame, files: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """(package, file_path, source, relation, target): the first ``limit`` edges (package, position, source, relation, target) that touch a node of the current file (package, file_path)."""
    own = nodes.select("package", "node_id", "file_path")
    touched = files.join(own, ["package", "file_path"]).select("package", "file_path", "node_id")
    ends = edges.withColumn("node_id", F.explode(F.array_distinct(F.array("source", "target"))))
    hit = ends.join(touched, ["package", "node_id"]).select("package", "file_path", "position", "source", "relation", "target").distinct()
    w = Window.partitionBy("package", "file_path").orderBy("position")
    return hit.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= limit).drop("__k", "position")


def discovery_order(field: Column) -> Column:
    """Quantity kinds first, then units, then the rest."""
    return F.when(field == "has_quantity_type", 0).when(field == "unit", 1).otherwise(2)


#: rows of distinct results that are broadcast at most
BROADCAST = 100_000


def joined_candidates(discoveries: DataFrame, results: DataFrame) -> DataFrame:
    """(pointer, uri, place) of the candidates that a field's queries found, in the order of its queries (``query_ids``) and of their results (query_id, position, uri), each uri once.

    A query's results are first reduced to a row for each uri, however often it was found, and numbered, so that the
    order of a field's candidates is one number.
    """
    spark = discoveries.sparkSession
    once = results.groupBy("query_id", "uri").agg(F.min(F.struct("position")).alias("__at"))
    numbered = cut(once.select("query_id", "uri", F.row_number().over(Window.partitionBy("query_id").orderBy("__at", "uri")).cast("long").alias("__k")))
    few = numbered.limit(BROADCAST + 1).count() <= BROADCAST
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = discoveries.select("pointer", "query_ids").repartition(parts, "pointer").select("pointer", F.posexplode("query_ids").alias("__q", "query_id"))
    found = asked.join(F.broadcast(numbered) if few else numbered.hint("merge"), "query_id").select("pointer", "uri", (F.shiftleft(F.col("__q").cast("long"), 40) + F.col("__k")).alias("__at"))
    first = found.groupBy("pointer", "uri").agg(F.min("__at").alias("__at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("pointer").orderBy("__at"))).drop("__at")


def route_options(profile: DataFrame) -> DataFrame:
    """(vocabulary, rdf_type, count, properties) that a type can be looked up in: with terms, not of the quantity vocabularies, at most eight properties."""
    kept = profile.filter((F.col("count") > 0) & ~F.col("vocabulary").rlike("^https?://qudt.org/"))
    return kept.select("vocabulary", "rdf_type", "count", F.slice(F.array_sort("properties"), 1, 8).alias("properties"))


def selected_routes(selected: DataFrame, options: DataFrame, fallback: DataFrame) -> DataFrame:
    """(package, vocabulary, rdf_type): chosen routes (package, position, vocabulary, rdf_type) that are options, each once; a package without any takes the fallback routes (vocabulary, rdf_type)."""
    allowed = options.select("vocabulary", "rdf_type").distinct()
    own = selected.join(allowed, ["vocabulary", "rdf_type"], "left_semi").select("package", "vocabulary", "rdf_type").distinct()
    bare = selected.select("package").distinct().join(own.select("package").distinct(), "package", "left_anti")
    return own.unionByName(bare.withColumn("__k", F.lit(1)).join(fallback.distinct().withColumn("__k", F.lit(1)), "__k").select("package", "vocabulary", "rdf_type"))


def quantity_rank(text: Column, category: Column) -> Column:
    """Evidence for a number is best with a number, then with an equals sign, then from an instrument."""
    low = F.lower(text)
    return F.struct(low.rlike(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?").cast("int").alias("number"), low.contains("=").cast("int").alias("observed"), (category == "instrument_signal").cast("int").alias("instrument"))


def first_quantity(evidence: DataFrame, keys: Sequence[str], order: str, text: str, category: str) -> DataFrame:
    """(keys, value, unit) of the best evidence with a number; of equal ranks the first row counts."""
    rank = quantity_rank(F.col(text), F.col(category))
    own = evidence.withColumn("__r", rank).filter("__r.number = 1")
    best = own.groupBy(*keys).agg(F.min_by(text, F.struct(-F.col("__r.observed"), -F.col("__r.instrument"), F.col(order))).alias("__t"))
    return best.select(*keys, T.first_number("__t").alias("value"), T.infer_unit("__t").alias("unit"))


def filtered_ledger(candidates: DataFrame, content: str, assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routed evidence, and the ledger (candidate_id, reason) of what a chunk's candidates lose on the way: unsupported texts first, then what the assessment rejects."""
    from tessera.operators import evidence as E

    validated = E.validate(candidates, "evidence_text", content)
    dropped = validated.filter(~F.col("supported")).select("candidate_id", F.lit("evidence_text_unsupported").alias("reason"))
    routed = E.route_candidates(validated.filter("supported"), assessments)
    rejected = routed.filter("route = 'rejected_evidence'").select("candidate_id", F.lit("candidate_rejected").alias("reason"))
    return routed, dropped.unionByName(rejected)


def ledger_summary(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of filtered rows by reason."""
    return ledger.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


#: The stages of a workflow from which on a step is done, and those in which it runs.
STEPS = {
    "initial_context": (("initial_context_completed", "chunking", "extraction", "chunk_extraction", "chunk_repair", "interim_evidence_context", "vocabulary_normalization", "profile_projection", "profile_draft", "completed"), ("initial_context",)),
    "normalization": (("profile_projection", "completed"), ("vocabulary_normalization",)),
    "profile_projection": (("profile_draft", "completed"), ("profile_projection",)),
    "validation": (("completed",), ()),
}
EXTRACTING = ("initial_context_required", "file_ranking", "initial_file_summaries", "initial_overview", "chunk_extraction", "chunk_repair", "interim_evidence_context")
EXTRACTED = ("vocabulary_normalization", "profile_projection", "profile_draft", "completed")


def workflow_stage(workflow: Column, chunking: Column, extraction: Column, progress: Column, has_result: Column) -> Column:
    """The stage that the statuses of a workflow's parts amount to."""
    return (
        F.when(has_result | (extraction == "completed"), "completed")
        .when((workflow == "crashed") | (extraction == "crashed"), "crashed")
        .when((workflow == "cancelled") | (extraction == "cancelled"), "cancelled")
        .when(progress.isNotNull() & (progress != "pending"), progress)
        .when(extraction == "running", "extraction")
        .when(chunking == "running", "chunking")
        .when(chunking == "completed", "extraction_pending")
        .otherwise("pending")
    )


def step_statuses(stage: Column, workflow: Column, chunking: Column, extraction: Column, progress: Column) -> Column:
    """struct of a status for each step of a workflow."""
    at = F.coalesce(progress, F.lit(""))
    steps: dict[str, Column] = {"upload": F.lit("completed")}
    steps["initial_context"] = F.when(stage.isin(*STEPS["initial_context"][1]), "running").when(stage.isin(*STEPS["initial_context"][0]), "completed").otherwise("unknown")
    steps["chunking"] = chunking
    steps["extraction"] = F.when(at.isin(*EXTRACTING), "running").when(at.isin(*EXTRACTED), "completed").otherwise(extraction)
    for name in ("normalization", "profile_projection", "validation"):
        done, running = STEPS[name]
        steps[name] = (F.when(at.isin(*running), "running") if running else F.when(F.lit(False), "")).when(at.isin(*done), "completed").otherwise("unknown")
    steps = {k: F.when(stage == "completed", "completed").otherwise(v) for k, v in steps.items()}
    crashed = workflow == "crashed"
    steps["extraction"] = F.when(crashed & (chunking == "completed"), "crashed").otherwise(steps["extraction"])
    steps["chunking"] = F.when(crashed & (chunking != "completed"), "crashed").otherwise(steps["chunking"])
    return F.struct(*(v.alias(k) for k, v in steps.items()))


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.floor(c.cast("double") * 10 + 0.5) / 10)


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB or MB, the latter with one decimal (halves up)."""
    one = _one_decimal
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / 1024 / 1024), F.lit(" MB")))


def format_duration(ms: Column) -> Column:
    """Milliseconds as ms, from a thousand on as seconds with one decimal; ``N/A`` for null."""
    return F.when(ms.isNull(), "N/A").when(ms >= 1000, F.concat(_one_decimal(ms / 1000), F.lit(" s"))).otherwise(F.concat(F.floor(ms + 0.5).cast("long").cast("string"), F.lit(" ms")))


def files_of_groups(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(package, file_path, groups) and (package, group, files) of assignments (package, file_path, group), sorted."""
    a = assignments.distinct()
    return a.groupBy("package", "file_path").agg(F.array_sort(F.collect_list("group")).alias("groups")), a.groupBy("package", "group").agg(F.array_sort(F.collect_list("file_path")).alias("files"))


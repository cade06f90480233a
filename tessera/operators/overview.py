"""Package overviews: rule-based groups, role edges, target and role classifiers, a sanitiser with counted drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.evidence import first_wins

#: Groups of files, their relation to a file, and the words that put a file there.
GROUPS = (
    ("dataset_documentation", "documents", ("dataset description", "dataset documentation", "data descriptor", "human-readable")),
    ("audit_provenance", "documents", ("audit", "provenance", "trail", "log", "history", "hash")),
    ("acquisition_settings", "parameterizes", ("acquisition", "acquire", "measurement setting", "acquisition parameter")),
    ("processing_settings", "parameterizes", ("processing", "process parameter", "processing parameter", "processed parameter")),
    ("instrument_settings", "parameterizes", ("instrument settings", "calibration", "reference", "settings")),
    ("method_program", "configures", ("method program", "experiment program", "method logic", "protocol", "workflow")),
    ("raw_data", "describes", ("raw data", "raw measurements", "primary measurements")),
    ("processed_data", "describes", ("processed data", "processed spectrum", "processed output")),
    ("derived_results", "describes", ("derived result", "peak list", "result table", "annotation")),
    ("parameter_settings", "parameterizes", ("parameter file", "parameter values", "configuration", "settings", "key-value pairs", "parameters")),
    ("ambiguous_supporting_resources", "uncertain_relation", ("unclear", "not clear", "purpose cannot", "empty content", "arbitrary units")),
)
GENERIC, SPECIFIC = "parameter_settings", ("acquisition_settings", "processing_settings", "instrument_settings")
#: Relations between groups that are both there.
ROLE_EDGES = (
    ("method_program", "configures", "acquisition_settings"),
    ("instrument_settings", "parameterizes", "acquisition_settings"),
    ("acquisition_settings", "parameterizes", "raw_data"),
    ("processing_settings", "parameterizes", "processed_data"),
    ("processed_data", "derives_from", "raw_data"),
    ("derived_results", "derives_from", "processed_data"),
)


def group_names(summary: Column) -> Column:
    """Groups whose words a summary holds without a negation before them; the generic one gives way to specific ones."""
    found = []
    for name, _, words in GROUPS:
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.lower(summary).contains(w) & ~T.negated(summary, w))
        found.append(F.when(hit, F.lit(name)))
    every = F.array_compact(F.array(*found))
    return F.when(F.arrays_overlap(every, F.array(*map(F.lit, SPECIFIC))), F.array_remove(every, GENERIC)).otherwise(every)


def assign_groups(df: DataFrame, id_col: str, summary_col: str) -> DataFrame:
    """(id, group, relation) of every group a file belongs to."""
    relation = F.lit(None).cast("string")
    for name, r, _ in GROUPS:
        relation = F.when(F.col("group") == name, F.lit(r)).otherwise(relation)
    # the summary and its groups are one projection, so the rules run once a row
    return df.select(id_col, F.explode(group_names(F.col(summary_col))).alias("group")).withColumn("relation", relation)


def role_edges(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(source, relation, target) of the static edges whose groups are both present (per ``keys``)."""
    present = groups.groupBy(*keys).agg(F.collect_set("group").alias("present"))
    edges = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(r).alias("relation"), F.lit(t).alias("target")) for s, r, t in ROLE_EDGES))
    live = F.filter(edges, lambda e: F.array_contains("present", e["source"]) & F.array_contains("present", e["target"]))
    return present.select(*keys, F.explode(live).alias("e")).select(*keys, "e.source", "e.relation", "e.target")


def sanitise_edges(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds ``drop_reason`` (null: kept) to (edge_id, source, relation, target, evidence).

    In order: dangling, self loop, containment that isn't seeded, weak evidence,
    repeated (of equal edges the first by ``edge_id`` stays, seeded ones count as first).
    """
    known = nodes.select(F.col("node_id").alias("__id")).distinct()
    joined = edges.join(known.select(F.col("__id").alias("source"), F.lit(True).alias("__s")), "source", "left").join(known.select(F.col("__id").alias("target"), F.lit(True).alias("__t")), "target", "left")
    keys = ["source", "relation", "target"]
    joined = joined.join(seeds.select(*keys).distinct().withColumn("__seed", F.lit(True)), keys, "left")
    weak = F.size(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: (F.length(T.strip(e)) >= 3) & ~F.lower(T.strip(e)).isin("n/a", "none", "unknown", "string"))) == 0
    reason = (
        F.when(F.col("__s").isNull() | F.col("__t").isNull(), "dangling").when(F.col("source") == F.col("target"), "self_loop")
        .when((F.col("relation") == "contains") & F.col("__seed").isNull(), "containment").when(weak & (F.col("relation") != "contains"), "weak_evidence").when(F.col("__seed"), "repeated")
    )
    marked = joined.withColumn("drop_reason", reason)
    first = first_wins(marked.filter("drop_reason is null"), keys, ["edge_id"]).select("edge_id", F.lit(True).alias("__first"))
    out = marked.join(first, "edge_id", "left")
    return out.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("__first").isNull(), "repeated").otherwise(F.col("drop_reason"))).select("edge_id", *keys, "drop_reason")


def has_device(text: Column) -> Column:
    return F.lower(text).rlike("instrument|device|equipment|sensor|apparatus")


def note_target(category: Column, text: Column) -> Column:
    """struct(path, class) of the document place that an evidence note belongs to; null fields where there is none."""
    low = F.lower(text)
    has = lambda *w: low.rlike("|".join(w))
    to = lambda p, c=None: F.struct(F.lit(p).cast("string").alias("path"), F.lit(c).cast("string").alias("class"))
    dated = has("date", "timestamp", "modified", "modification")
    around = category == "surrounding_signal"
    return (
        F.when(category == "measurement_signal", to(None))
        .when(category.isin("software_signal", "instrument_signal") | has_device(text), to("/was_generated_by/0/carried_out_by/-", "AgenticEntity"))
        .when(around & dated, to("/modification_date"))
        .when(around & has("origin", "owner", "creator", "author", "team", "laboratory"), to("/creator/-", "Agent"))
        .when((category == "activity_signal") | has("experiment", "acquisition", "generation", "measurement activity", "workflow"), to("/was_generated_by/-", "DataGeneratingActivity"))
        .when(category == "method_signal", to("/was_generated_by/0/realized_plan", "Plan"))
        .when(has("dataset name", "title", "name"), to("/title"))
        .when(dated, to("/modification_date"))
        .otherwise(to(None))
    )


#: Role of a parent by its path and words, first match wins.
PARENT_ROLES = (
    ("/carried_out_by/", (("software", "topspin|software|dirdata"), ("pulse_program", "pulse|zg30|program"), ("manufacturer", "bruker|biospin|manufacturer|gmbh"), ("instrument", "spectrometer|instrument|avance")), "agent"),
    ("/evaluated_entity/", (("solvent", "cdcl|solvent|chloroform"), ("target_nucleus", "nucleus|proton|1h|target")), "evaluated_entity"),
    ("/had_input_entity/", (("pulse_program", "pulse|zg30|program"), ("parameter_file", "parameter|jcamp|file|acqu|proc")), "input_entity"),
    ("/had_output_entity/", (("audit_trail", "audit|trail|log"), ("output_spectrum", "spectrum|spectra|processed")), "output_entity"),
)
#: Family of an attribute by its words, first match wins.
FAMILIES = (
    ("spectrometer_frequency", "mhz|frequency|spectrometer"),
    ("software_version", r"software|topspin version|\bversion\b"),
    ("pulse_program", "pulse|zg30"),
    ("solvent", "cdcl|solvent"),
    ("activity_target", "proton|nucleus|activity target"),
    ("experiment_type", "experiment type"),
    ("file_format", "format|proprietary"),
    ("data_hash", "hash|md5"),
    ("acquisition_parameter", r"jcamp|data span|relaxation|flip|mcwrk|\bfov\b|\bsw\b"),
    ("instrument_parameter", "amplifier|blanking|current limit|gab"),
)
#: Families that a role takes; every other role takes ``generic`` only.
ALLOWED = {
    "activity": ("spectrometer_frequency", "software_version", "pulse_program", "solvent", "activity_target", "experiment_type", "acquisition_parameter", "instrument_parameter", "generic"),
    "instrument": ("spectrometer_frequency", "instrument_parameter", "generic"),
    "manufacturer": ("generic",),
    "software": ("software_version", "acquisition_parameter", "instrument_parameter", "generic"),
    "pulse_program": ("pulse_program", "activity_target", "acquisition_parameter", "generic"),
    "target_nucleus": ("activity_target", "generic"),
    "solvent": ("solvent", "generic"),
    "parameter_file": ("software_version", "experiment_type", "acquisition_parameter", "file_format", "generic"),
    "output_spectrum": ("file_format", "generic"),
    "audit_trail": ("file_format", "generic"),
}


def parent_role(path: Column, words: Column, kind: Column) -> Column:
    low, out = T.normalise_label(words), F.lower(F.coalesce(kind, F.lit("unknown")))
    for part, tests, default in reversed(PARENT_ROLES):
        role = F.lit(default)
        for name, pattern in reversed(tests):
            role = F.when(low.rlike(pattern), F.lit(name)).otherwise(role)
        out = F.when(path.contains(part), role).otherwise(out)
    return F.when(path.rlike(r"^/was_generated_by/\d+$") | path.endswith("/was_generated_by/0"), "activity").otherwise(out)


def attribute_family(words: Column) -> Column:
    low, out = T.normalise_label(words), F.lit("generic")
    for name, pattern in reversed(FAMILIES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def family_allowed(role: Column, family: Column) -> Column:
    out = family == "generic"
    for name, families in ALLOWED.items():
        out = out | ((role == name) & family.isin(*families))
    return out


#: Prefixes of types that describe a vocabulary rather than belong to it.
META_TYPES = (
    "owl__Ontology", "owl__Axiom", "owl__Restriction", "owl__AllDifferent", "owl__AllDisjointClasses", "owl__AnnotationProperty", "owl__ObjectProperty", "owl__DatatypeProperty", "owl__InverseFunctionalProperty",
    "owl__IrreflexiveProperty", "owl__SymmetricProperty", "owl__FunctionalProperty", "owl__TransitiveProperty", "owl__Nothing", "owl__NegativePropertyAssertion", "owl__DeprecatedProperty", "owl__DeprecatedClass",
    "rdfs__Datatype", "rdfs__Container", "rdfs__ContainerMembershipProperty", "skos__ConceptScheme", "schema__Organization", "schema__Person", "vaem__CatalogEntry", "vaem__GraphMetaData", "swrl__", "bnode__", "qudt__", "obo__",
)
KEPT_TYPES = ("qudt__QuantityKind", "qudt__Unit", "qudt__ConstantValue")
#: Parts of property names that aren't indexed.
META_PROPERTIES = ("date", "version", "note", "created", "modified", "issued", "license", "creator", "contributor", "publisher", "contact", "embedding", "embeddings", "uri")


def indexable_type(c: Column) -> Column:
    meta = F.lit(False)
    for p in META_TYPES:
        meta = meta | c.startswith(p)
    return c.isin(*KEPT_TYPES) | ~meta


def indexable_property(c: Column) -> Column:
    return ~F.lower(c).rlike("|".join(META_PROPERTIES))

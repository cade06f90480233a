"""Where evidence belongs: scores against parents and schema branches, target hints, projection groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.overview import attribute_family, family_allowed, has_device

LEAST = 5
#: By role of the parent, points for evidence of these categories or with these words.
#: (points, categories, words, both needed)
ROLE_POINTS = {
    "manufacturer": ((2, (), ".", False),),
    "software": ((5, ("software_signal",), "software|topspin", False), (2, (), "version|parameter|config|topspin", False)),
    "pulse_program": ((5, ("method_signal",), "pulse|zg30|program", False), (-4, (), "software version|solvent|frequency|mhz", False)),
    "target_nucleus": ((5, (), "nucleus|proton|1h|target", False), (-4, (), "solvent|cdcl|pulse|zg30|frequency|mhz", False)),
    "solvent": ((6, (), "solvent|cdcl|chloroform", False), (-3, (), "pulse|frequency|mhz", False)),
    "parameter_file": (
        (4, ("software_signal", "instrument_signal", "measurement_condition", "resource_signal"), None, False),
        (4, (), "jcamp|parameter|acqu|proc|sw|fov|experiment type", False),
        (-8, (), "frequency|mhz|bf1|bf2|bf3", False),
        (-3, (), "solvent|pulse program", False),
    ),
    "output_spectrum": ((5, ("resource_signal",), "spectrum|spectra|output|format", True), (-5, (), "frequency|mhz|solvent|pulse|zg30", False)),
    "audit_trail": ((5, ("resource_signal", "surrounding_signal"), "audit|trail|log", True), (-5, (), "frequency|mhz|solvent|pulse|zg30", False)),
    "activity": ((4, ("activity_signal", "method_signal", "instrument_signal", "software_signal", "measurement_condition"), None, False), (2, (), "acquisition|processing|experiment", False)),
}


def role_points(role: Column, category: Column, text: Column) -> Column:
    out = F.lit(0)
    for name, rules in ROLE_POINTS.items():
        for points, categories, words, both in rules:
            tests = ([category.isin(*categories)] if categories else []) + ([text.rlike(words)] if words else [])
            hit = tests[0] if len(tests) == 1 else (tests[0] & tests[1] if both else tests[0] | tests[1])
            out = out + F.when((role == name) & hit, points).otherwise(0)
    return out


def score_parents(parents: DataFrame, evidence: DataFrame, limit: int = 4) -> DataFrame:
    """(doc, parent, candidate_id, score, position): the best evidence of each parent in its own document.

    Parents are (doc, parent, role, title, words), evidence (doc, candidate_id, category, text).
    Shared words of the title count four each, of all words up to three in all;
    a manufacturer needs a word of its title and nothing about settings.
    """
    p = parents.select("doc", "parent", "role", T.terms(F.coalesce("title", F.lit(""))).alias("__t"), T.terms(F.coalesce("words", F.lit(""))).alias("__w"))
    e = evidence.select("doc", "candidate_id", "category", T.normalise_label(F.coalesce("text", F.lit(""))).alias("__x")).withColumn("__own", F.split("__x", " "))
    # only what shares a term, or has points for the parent's role, is brought together
    terms = p.select("doc", "parent", F.explode(F.array_union("__t", "__w")).alias("__term"))
    words = e.select("doc", "candidate_id", F.explode(F.array_distinct("__own")).alias("__term"))
    liked = F.filter(F.array(*(F.when(role_points(F.lit(r), F.col("category"), F.col("__x")) > 0, F.lit(r)) for r in ROLE_POINTS)), lambda r: r.isNotNull())
    roles = e.select("doc", "candidate_id", F.explode(liked).alias("role"))
    pairs = terms.join(words, ["doc", "__term"]).select("doc", "parent", "candidate_id").union(p.join(roles, ["doc", "role"]).select("doc", "parent", "candidate_id")).distinct()
    j = pairs.join(p, ["doc", "parent"]).join(e, ["doc", "candidate_id"])
    hits = lambda c: F.size(F.array_intersect(F.array_distinct(c), "__own"))
    title, words = hits(F.col("__t")), hits(F.col("__w"))
    base = title * 4 + F.least(words, F.lit(3)) + role_points(F.col("role"), F.col("category"), F.col("__x"))
    barred = (F.col("role") == "manufacturer") & ((title == 0) | F.col("__x").rlike("frequency|mhz|version|topspin|pulse|solvent"))
    scored = j.withColumn("score", F.when(barred, 0).otherwise(base)).filter(F.col("score") >= LEAST)
    w = Window.partitionBy("doc", "parent").orderBy(F.desc("score"), "candidate_id")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("doc", "parent", "candidate_id", "score", "position")


#: Points for a branch by hint of the query: (hint, points, column, values).
BRANCH_POINTS = (
    ("device", 30, "range_class", ("AgenticEntity",)),
    ("device", 45, "slot", ("carried_out_by",)),
    ("method", 30, "slot", ("was_generated_by", "is_about_activity", "realized_plan")),
    ("method", 20, "range_class", ("DataGeneratingActivity", "EvaluatedActivity", "Plan")),
    ("file_format", 35, "slot", ("dataset_distribution", "format", "media_type", "type")),
    ("dataset_identity", 40, "slot", ("title", "identifier")),
    ("measured_entity", 35, "slot", ("evaluated_entity", "is_about_entity")),
    ("measured_entity", 20, "range_class", ("EvaluatedEntity", "Entity")),
    ("date", 35, "slot", ("modification_date", "release_date")),
)


def branch_points(hints: Column, slot: Column, range_class: Column, depth: Column, recommended: Column, shared_terms: Column) -> Column:
    """Two points a shared term, the hints' points, five if recommended, less twenty a level; broad text slots and bare settings lose 25."""
    out = shared_terms * 2 + F.when(recommended, 5).otherwise(0) - depth * 20
    for hint, points, column, values in BRANCH_POINTS:
        out = out + F.when(F.array_contains(hints, hint) & {"slot": slot, "range_class": range_class}[column].isin(*values), points).otherwise(0)
    broad = slot.isin("description", "title", "keyword") & ~F.array_contains(hints, "dataset_identity")
    bare = F.array_contains(hints, "parameter_setting") & (F.size(F.array_except(hints, F.array(F.lit("parameter_setting")))) == 0)
    return out - F.when(broad, 25).otherwise(0) - F.when(bare, 25).otherwise(0)


def target_hint(category: Column, text: Column) -> Column:
    """struct(path, class) of the place that a group of evidence is projected to."""
    low = F.lower(text)
    to = lambda p, c=None: F.struct(F.lit(p).alias("path"), F.lit(c).cast("string").alias("class"))
    return (
        F.when(category == "measurement_signal", to(""))
        .when(category.isin("software_signal", "instrument_signal") | has_device(text), to("/was_generated_by/0/carried_out_by/-", "AgenticEntity"))
        .when((category == "surrounding_signal") & low.rlike("origin|owner|creator|author|team|laboratory"), to("/creator/0", "Agent"))
        .when((category == "activity_signal") | low.rlike("experiment|acquisition|generation|workflow"), to("/was_generated_by/0", "DataGeneratingActivity"))
        .when(category == "method_signal", to("/was_generated_by/0/realized_plan", "Plan"))
        .when(low.rlike("dataset name|title|name"), to("/title"))
        .when(low.rlike("date|timestamp|modified|modification"), to("/modification_date"))
        .when(low.rlike("type|category|class"), to("/type/0", "Concept"))
        .otherwise(to("/description"))
    )


def note_family(note_id: Column) -> Column:
    """An id without the digits and signs at its end."""
    short = F.regexp_replace(note_id, r"[0-9_.\-]+$", "")
    return F.when(short != "", short).otherwise(F.coalesce(F.nullif(note_id, F.lit("")), F.lit("unnamed")))


def projection_groups(notes: DataFrame, order: str, size: int = 6) -> DataFrame:
    """(group_id, path, class, category, note_ids): notes of one target, category, file and family, at most ``size`` together."""
    hinted = notes.withColumn("__h", target_hint(F.col("category"), F.concat_ws(" ", "note_id", "category", "text"))).filter(F.col("__h.path") != "")
    keys = [F.col("__h.path"), F.col("__h.class"), F.col("category"), F.col("file_path"), note_family(F.col("note_id"))]
    w = Window.partitionBy(*keys).orderBy(order, "note_id")
    dealt = hinted.withColumn("__family", note_family(F.col("note_id"))).withColumn("__part", F.floor((F.row_number().over(w) - 1) / size))
    groups = dealt.groupBy(F.col("__h.path").alias("path"), F.col("__h.class").alias("class"), "category", "file_path", "__family", "__part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "note_id"))).alias("x"))
    ids = F.transform("x", lambda r: r["note_id"])
    name = F.coalesce(F.nullif(F.replace(F.regexp_replace("path", "^/+|/+$", ""), F.lit("/"), F.lit(".")), F.lit("")), F.lit("root"))
    return groups.select(F.concat(F.lit("group:"), name, F.lit(":"), F.substring(F.sha1(F.array_join(ids, "|")), 1, 12)).alias("group_id"), "path", "class", "category", ids.alias("note_ids"))


def placement_ok(role: Column, words: Column, label: Column, evidence: Column) -> Column:
    """Whether an attribute may stand under a parent: its family suits the role and its label has a word in the evidence."""
    return family_allowed(role, attribute_family(words)) & F.arrays_overlap(T.terms(label), F.split(T.normalise_label(evidence), " "))


def unit_candidates(candidates: DataFrame, role: str) -> DataFrame:
    """Vocabulary candidates of a role (``kind`` or ``unit``) by their namespace, each uri once."""
    prefix = {"kind": "http://qudt.org/vocab/quantitykind/", "unit": "http://qudt.org/vocab/unit/"}[role]
    return candidates.filter(F.col("uri").startswith(prefix)).dropDuplicates(["uri"])


def compatible_units(statements: DataFrame, kind: str) -> DataFrame:
    """Units that are stated to have the quantity kind."""
    return statements.filter((F.col("p") == "qudt__hasQuantityKind") & (F.col("o") == kind)).select(F.col("s").alias("unit")).distinct()

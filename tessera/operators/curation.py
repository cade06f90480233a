"""Drafts under curation: attribute owners, labels, guards, quality states, marks.

Documents are handled as their leaf tables (id, pointer, type, value), so that what
concerns a path is a join or an aggregate over paths, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ledgers import same_value

ATTRIBUTE_ARRAYS = ("has_quantitative_attribute", "has_qualitative_attribute")
#: Relations of an activity whose objects can own attributes, and their classes.
RELATIONS = (
    ("carried_out_by", "AgenticEntity"),
    ("evaluated_entity", "EvaluatedEntity"),
    ("evaluated_activity", "EvaluatedActivity"),
    ("had_input_entity", "EvaluatedEntity"),
    ("had_input_activity", "EvaluatedActivity"),
    ("had_output_entity", "EvaluatedEntity"),
)
#: Words of a title that say nothing about an attribute.
LABEL_STOP_WORDS = (
    "the of for in and a an is are was were be been being have has had do does did will would could should may might must can shall this that these those it its"
    " they them their there here where when how why what which who whom whose data set dataset record file source entity activity"
).split()
#: Wordings that stand for a missing method.
ABSENT = ("no explicit method", "no method evidence", "no evidence available", "not available", "not specified", "unknown method")
TECHNICAL = r"\b(software|instrument|device|equipment|sensor|application)\b"
PLACEHOLDER = "activity_evaluation_target"


def plain(value: Column) -> Column:
    """The text of a leaf: JSON strings without their quotes, null as an empty text."""
    quoted = value.startswith('"')
    return F.when(value == "null", "").when(quoted, F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]).otherwise(value)


def present(leaves: DataFrame) -> DataFrame:
    """Leaves that hold a value."""
    return leaves.filter(~F.col("value").isin('""', "null", "[]", "{}"))


def attribute_items(leaves: DataFrame, arrays: Sequence[str] = ATTRIBUTE_ARRAYS) -> DataFrame:
    """(id, array, index, field, value) of the fields of attributes; a nested array's items belong to the inner array."""
    pattern = rf"^(.*/(?:{'|'.join(arrays)}))/(\d+)/(.+)$"
    g = lambda k: F.regexp_extract("pointer", pattern, k)
    return leaves.filter(F.col("pointer").rlike(pattern)).select("id", g(1).alias("array"), g(2).cast("int").alias("index"), g(3).alias("field"), plain(F.col("value")).alias("value"))


def vocabulary_sources(leaves: DataFrame, fields: Sequence[str], synthetic: str = "unit") -> DataFrame:
    """(id, pointer, field, value, synthetic) of what a vocabulary can name: texts of the enrichable ``fields``, and for each quantity without a ``synthetic`` field a row at the place where it would stand."""
    field = F.element_at(F.split("pointer", "/"), -1)
    texts = leaves.filter((F.col("type") == "string") & field.isin(*fields)).select("id", "pointer", field.alias("field"), plain(F.col("value")).alias("value"), F.lit(False).alias("synthetic")).filter("value <> ''")
    own = attribute_items(leaves, [ATTRIBUTE_ARRAYS[0]]).filter(~F.col("field").contains("/"))
    item = F.concat_ws("/", "array", F.col("index").cast("string"))
    lacking = own.groupBy("id", item.alias("item")).agg(F.max(F.when(F.col("field") == "has_quantity_type", F.col("value"))).alias("value"), F.bool_or((F.col("field") == synthetic) & (F.col("value") != "")).alias("has"))
    made = lacking.filter("not has and value <> ''").select("id", F.concat("item", F.lit(f"/{synthetic}")).alias("pointer"), F.lit(synthetic).alias("field"), "value", F.lit(True).alias("synthetic"))
    return texts.unionByName(made)


def attribute_owners(leaves: DataFrame) -> DataFrame:
    """(id, path, class, title, description) of activities and of the objects of their relations that have a title or a description."""
    names = "|".join(name for name, _ in RELATIONS)
    pattern = rf"^(/was_generated_by/\d+(?:/(?:{names})/\d+)?)/(title|description)(?:/\d+)?$"
    path, field = F.regexp_extract("pointer", pattern, 1), F.regexp_extract("pointer", pattern, 2)
    own = present(leaves).filter(F.col("pointer").rlike(pattern)).select("id", path.alias("path"), field.alias("field"), "pointer", plain(F.col("value")).alias("value"))
    text = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("pointer", "value")))), lambda r: r["value"]), " ")
    made = own.groupBy("id", "path").agg(text("title").alias("title"), text("description").alias("description"))
    kind = F.lit("DataGeneratingActivity")
    for name, cls in RELATIONS:
        kind = F.when(F.col("path").rlike(f"/{name}/"), cls).otherwise(kind)
    return made.select("id", "path", kind.alias("class"), "title", "description")


def title_words(title: Column) -> Column:
    """Words of an owner's title that an attribute's label need not repeat: three letters or more, none of the usual ones, longest first."""
    words = F.array_distinct(F.filter(F.split(T.normalise_label(title), " "), lambda w: (F.length(w) > 2) & ~w.isin(*LABEL_STOP_WORDS)))
    return F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def clean_label(label: Column, words: Column) -> Column:
    """A label without an owner's words and a file number at its end; null where nothing changes or nothing would be left."""
    less = F.aggregate(words, label, lambda acc, w: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\b"), F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\b")), F.lit("")))
    less = F.regexp_replace(F.regexp_replace(less, r"\s*-\s*\d+\s*$", ""), r"\s*-\s*$", "")
    less = T.strip(F.regexp_replace(less, r"\s+", " "))
    return F.when((F.size(words) > 0) & (less != "") & (less != label), less)


def concrete_targets(activities: DataFrame) -> DataFrame:
    """(id, activity, n_targets, self_references) from rows (id, activity, activity_id, relation, target_id, title, description), a row for each evaluated target and one without relation for an activity that has none.

    A target counts if it is named and isn't the activity itself or a placeholder.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own, target = F.trim(F.coalesce("activity_id", F.lit(""))), F.trim(F.coalesce("target_id", F.lit("")))
    itself = (F.col("relation") == "evaluated_activity") & (own != "") & (own == target)
    holder = (text("target_id") == PLACEHOLDER) | (text("title") == PLACEHOLDER) | (text("description").contains("requirement") & ~text("description").contains("evidence"))
    named = (target != "") | (text("title") != "") | (text("description") != "")
    counts = F.col("relation").isNotNull() & ~itself & ~holder & named
    return activities.groupBy("id", "activity").agg(F.count_if(F.coalesce(counts, F.lit(False))).alias("n_targets"), F.count_if(F.coalesce(itself, F.lit(False))).alias("self_references"))


def bad_range(title: Column, description: Column, quantity: Column, unit: Column) -> Column:
    """Whether an attribute reads like a collapsed range."""
    text = F.concat_ws(" ", *(T.normalise_label(F.coalesce(c, F.lit(""))) for c in (title, description, quantity, unit)))
    return text.contains("range") | text.rlike(r"\bto\b")


def is_technical(*parts: Column) -> Column:
    return T.normalise_label(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))).rlike(TECHNICAL)


def is_absence(text: Column) -> Column:
    return T.normalise_label(F.coalesce(text, F.lit(""))).rlike("|".join(ABSENT))


def guard_status(requirement: Column, status: Column, has_evidence: Column, placed: Column, facts: dict[str, Column]) -> Column:
    """The status of a requirement after mechanical checks of the document.

    ``facts``: ``bad_ranges``, ``agents``, ``technical_agents``, ``activities``, ``targeted`` and
    ``planned`` activities, ``self_references``, all counts in the document.
    """
    f = {k: F.coalesce(v, F.lit(0)) for k, v in facts.items()}
    unplaced = F.when((status == "fulfilled") & ~placed, F.when(has_evidence, "partial").otherwise("missing")).otherwise(status)
    targets = F.when((f["activities"] == 0) | (f["targeted"] == 0), "missing").when((f["self_references"] > 0) | (f["targeted"] < f["activities"]), "partial").otherwise("fulfilled")
    plans = F.when((f["activities"] == 0) | (f["planned"] == 0), "missing").when(f["planned"] < f["activities"], "partial").otherwise(unplaced)
    return (
        F.when(requirement == "attribute_range_decomposition", F.when(f["bad_ranges"] > 0, "partial").otherwise("fulfilled"))
        .when((requirement == "technical_agent_kind") & (f["agents"] > 0) & (f["technical_agents"] == f["agents"]), "fulfilled")
        .when(requirement == "activity_evaluation_target", targets)
        .when(requirement == "method_plan_presence", plans)
        .otherwise(unplaced)
    )


def source_trace(used: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, score, used_evidence_count): mean match score of the distinct used evidence (keys, candidate_id) that exists; 0 without any."""
    k = list(keys)
    own = used.select(*k, "candidate_id").distinct().join(candidates.select("candidate_id", F.coalesce("evidence_match_score", F.lit(0.0)).alias("m")), "candidate_id", "left")
    return own.groupBy(*k).agg(F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 6).alias("score"), F.count("m").alias("used_evidence_count"))


def quality_state(documents: DataFrame, errors: DataFrame, requirements: DataFrame, fields: DataFrame, trace: DataFrame) -> DataFrame:
    """(id, schema_valid, profile_conformant, evidence_grounded, issues) of every document.

    ``issues`` are sorted ``code:path`` texts of what blocks it: schema errors (id, pointer),
    applicable requirements (id, requirement_id, status, applicable) that aren't fulfilled, and ledger rows
    (id, pointer, status) that are invalid. Without any requirement conformance is unknown (null).
    """
    unmet = requirements.filter(F.col("applicable") & ~F.col("status").isin("fulfilled", "not_applicable"))
    every = (
        errors.select("id", F.lit("schema_invalid").alias("code"), F.col("pointer").alias("at"))
        .unionByName(unmet.select("id", F.lit("requirement_unmet").alias("code"), F.col("requirement_id").alias("at")))
        .unionByName(fields.filter("status = 'invalid'").select("id", F.lit("field_completion_issue").alias("code"), F.col("pointer").alias("at")))
    )
    summed = every.groupBy("id").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "code", "at"))).alias("issues"), F.bool_or(F.col("code") == "schema_invalid").alias("__bad"), F.bool_or(F.col("code") == "requirement_unmet").alias("__unmet")
    )
    asked = requirements.select("id").distinct().withColumn("__asked", F.lit(True))
    joined = documents.select("id").join(summed, "id", "left").join(asked, "id", "left").join(trace.select("id", "used_evidence_count"), "id", "left")
    valid, no = ~F.coalesce("__bad", F.lit(False)), F.lit(False)
    return joined.select(
        "id",
        valid.alias("schema_valid"),
        F.when(F.col("__asked"), valid & ~F.coalesce("__unmet", no)).alias("profile_conformant"),
        F.when(F.col("__asked"), F.coalesce("used_evidence_count", F.lit(0)) > 0).alias("evidence_grounded"),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
    )


def mark_curated(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """The field ledger (id, pointer, field_name, status, issue_categories, edit_needed_reason) after marks (id, pointer, status).

    A marked row takes the status and loses its reason and the category
    ``non_enriched``; a mark without a row becomes one. Of several marks of one place the greatest status counts.
    """
    m = marks.groupBy("id", "pointer").agg(F.max("status").alias("__mark"))
    marked = F.col("__mark").isNotNull()
    joined = ledger.join(m, ["id", "pointer"], "full_outer")
    none = F.array().cast("array<string>")
    return joined.select(
        "id",
        "pointer",
        F.coalesce("field_name", F.element_at(F.filter(F.split("pointer", "/"), lambda p: ~p.rlike(r"^\d*$")), -1)).alias("field_name"),
        F.coalesce("__mark", "status").alias("status"),
        F.when(marked, F.array_remove(F.coalesce("issue_categories", none), "non_enriched")).otherwise(F.col("issue_categories")).alias("issue_categories"),
        F.when(marked, "").otherwise(F.col("edit_needed_reason")).alias("edit_needed_reason"),
    )


def path_allowed(target: Column, allowed: Column) -> Column:
    """Whether a write's target is one of the allowed paths or below one."""
    bare = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, "/+$", ""), F.lit("")), F.lit("/"))
    t = bare(target)
    return F.exists(allowed, lambda a: (t == bare(a)) | t.startswith(F.concat(bare(a), F.lit("/"))))


def instance_signature(title: Column, kind: Column) -> Column:
    """Title and type in lower case and single spaces, null without a title: equal signatures are one instance."""
    low = lambda c: F.lower(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.when(low(title) != "", F.concat_ws("\u0001", low(title), low(kind)))


def quantity_signature(quantity: Column, value: Column, unit: Column) -> Column:
    """Quantity, number and unit of an attribute as one text, null without quantity or number."""
    low = lambda c: F.lower(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0).try_cast("double")
    return F.when((low(quantity) != "") & number.isNotNull(), F.concat_ws("\u0001", low(quantity), number.cast("string"), low(unit)))


def duplicate_writes(writes: DataFrame, existing: DataFrame, keys: Sequence[str] = ("id", "target")) -> DataFrame:
    """Writes (keys, instance_id, title, type) with ``duplicate``: whether the place already holds the instance, by id or by signature."""
    k = list(keys)
    by_id = existing.filter("instance_id <> ''").select(*k, F.trim("instance_id").alias("__i")).distinct().withColumn("__same_id", F.lit(True))
    by_sig = existing.select(*k, instance_signature(F.col("title"), F.col("type")).alias("__s")).filter("__s is not null").distinct().withColumn("__same_sig", F.lit(True))
    own = writes.withColumn("__i", F.trim("instance_id")).withColumn("__s", instance_signature(F.col("title"), F.col("type")))
    joined = own.join(by_id, [*k, "__i"], "left").join(by_sig, [*k, "__s"], "left")
    return joined.select(*writes.columns, F.coalesce("__same_id", "__same_sig", F.lit(False)).alias("duplicate"))


def append_relations(existing: DataFrame, intents: DataFrame, kind: str, package: Column) -> DataFrame:
    """(activity, position, instance_id, title, description) of the relation objects to append.

    Intents (activity, position, title, description) whose generated id an object of the
    activity has (existing: activity, instance_id) are dropped, later ones of one id
    too; an input entity isn't named like a file.
    """
    title, description = T.strip(F.coalesce("title", F.lit(""))), T.strip(F.coalesce("description", F.lit("")))
    label = F.when(title != "", title).otherwise(description)
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    made = intents.select(
        "activity", "position", F.concat(package, F.lit(f":{kind}:"), F.coalesce(F.nullif(slug, F.lit("")), F.col("position").cast("string"))).alias("instance_id"), title.alias("title"), description.alias("description"), label.alias("__label")
    ).filter("__label <> ''")
    if kind == "input-entity":
        made = made.filter(~looks_like_file(F.col("title")))
    key = T.normalise_label("instance_id")
    known = existing.select("activity", T.normalise_label("instance_id").alias("__k")).distinct()
    first = made.withColumn("__k", key).groupBy("activity", "__k").agg(F.min_by(F.struct("position", "instance_id", "title", "description"), "position").alias("x"))
    return first.join(known, ["activity", "__k"], "left_anti").select("activity", "x.*")


def looks_like_file(label: Column) -> Column:
    """A path, or a name with an extension that has a letter."""
    s = T.strip(F.coalesce(label, F.lit("")))
    slashed = F.replace(s, F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(slashed, "/"), -1)
    ext = F.regexp_extract(base, r"\.([A-Za-z0-9]{1,8})$", 1)
    return (s != "") & (F.length(s) <= 180) & (base != "") & ((base != s) | ext.rlike("[A-Za-z]"))


def cross_parent_duplicates(attributes: DataFrame, order: str = "position") -> DataFrame:
    """(id, position, array, survivor): attributes (id, position, array, label, value, unit, score) that say the same under another owner of the document.

    Attributes of one document, label and unit with equal numbers make a group;
    the greatest score survives, of equal ones the first, and the others under
    any array are duplicates, if the group has two arrays. Values are compared in order of
    size, so a group is a run whose neighbours are equal, not a set of pairs.
    """
    w = Window.partitionBy("id", "label", "unit").orderBy("value", order)
    near = lambda other: F.coalesce(same_value(F.col("value"), other.over(w)), F.lit(False))
    marked = attributes.filter("id is not null and label is not null and unit is not null").withColumn("__new", (~near(F.lag("value"))).cast("int")).withColumn("__next", near(F.lead("value"))).withColumn("__run", F.sum("__new").over(w))
    # a run of one row has no duplicate; the others are few, and stay where they are
    runs = marked.filter((F.col("__new") == 0) | F.col("__next"))
    run = Window.partitionBy("id", "label", "unit", "__run")
    first = F.min(F.struct(-F.col("score"), F.col(order).alias("at"))).over(run)["at"]
    found = runs.withColumn("survivor", first).withColumn("__arrays", F.min("array").over(run) != F.max("array").over(run))
    return found.filter(F.col("__arrays") & (F.col(order) != F.col("survivor"))).select("id", order, "array", "survivor")


#: words that say nothing of where an attribute belongs; fixed values
INSIGNIFICANT_WORDS = ("the", "of", "for", "in", "and", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did")


def misplaced_attributes(attributes: DataFrame) -> DataFrame:
    """(id, activity, index): attributes of an activity that share two significant words with those of the entities it evaluates.

    Rows are (id, array, index, label); a word of an activity's own attributes is marked where
    its entities have it too, so no pair of attributes comes about and nothing is joined.
    """
    path = F.regexp_extract("array", r"^(/was_generated_by/\d+)/(?:evaluated_entity/\d+/)?has_quantitative_attribute$", 1)
    words = F.array_distinct(F.filter(F.split(T.normalise_label("label"), " "), lambda w: (F.length(w) > 1) & ~w.isin(*INSIGNIFICANT_WORDS)))
    inner = F.col("array").contains("/evaluated_entity/").alias("inner")
    own = attributes.filter("id is not null").select("id", inner, "index", path.alias("activity"), F.explode(words).alias("word")).filter("activity <> ''")
    theirs = F.max("inner").over(Window.partitionBy("id", "activity", "word"))
    return own.withColumn("theirs", theirs).filter("theirs and not inner").groupBy("id", "activity", "index").agg(F.count("*").alias("shared")).filter("shared >= 2").select("id", "activity", "index")

"""Evidence records: validation, routing, deduplication, ranking, windows and packets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.checkpoint import cut

MATCH, UNRANKED = 0.90, 10_000
#: Fixed values of an assessment where the critic gives none.
DEFAULT_ASSESSMENT = {
    "groundedness": "partial", "self_containedness": "partial", "scope_clarity": "partial", "portability": "partial",
    "semantic_interpretability": "partial", "environment_dependence": "medium", "specificity": "partial", "uncertainty": "medium",
}


def route(a: dict[str, Column]) -> Column:
    """struct(route, reason) of an assessment's judgements."""
    out = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    unclear = (a["self_containedness"] == "no") | (a["scope_clarity"] == "no") | (a["uncertainty"] == "high")
    portable = a["scope_clarity"].isin("yes", "partial") & (a["environment_dependence"] != "high")
    for name in ("groundedness", "self_containedness", "portability", "semantic_interpretability", "specificity"):
        portable = portable & (a[name] == "yes")
    return (
        F.when(a["groundedness"] == "no", out("rejected_evidence", "critic_not_grounded"))
        .when(unclear, out("contextual_evidence", "borderline_or_ambiguous"))
        .when(portable, out("portable_evidence", "portable_grounded_evidence"))
        .otherwise(out("contextual_evidence", "conservative_contextual_default"))
    )


def route_candidates(candidates: DataFrame, assessments: DataFrame) -> DataFrame:
    """Candidates with ``route`` and ``reason``; of several assessments of one candidate the last (by ``position``) counts, missing ones default."""
    names = list(DEFAULT_ASSESSMENT)
    last = assessments.groupBy("candidate_id").agg(F.max_by(F.struct(*names), F.col("position")).alias("__a"))
    joined = candidates.join(last, "candidate_id", "left")
    return joined.withColumn("__r", route({n: F.coalesce(F.col(f"__a.{n}"), F.lit(d)) for n, d in DEFAULT_ASSESSMENT.items()})).select(*candidates.columns, "__r.route", "__r.reason")


def match_score(evidence: str, content: str, least: float = MATCH) -> float:
    """1 where the normalised evidence stands in the content; else, from 12 characters on, the best ratio over windows of its length.

    Windows start every quarter of the length. Cheap upper bounds of a window's ratio come first, so the
    full comparison is made only where it can still beat the best one, and none after ``least`` is reached.
    """
    n = len(evidence)
    if not n or evidence in content:
        return 1.0 if n else 0.0
    if n < 12:
        return 0.0
    best, matcher = 0.0, SequenceMatcher(None, autojunk=True)
    windows = [content[at : at + n] for at in range(0, max(0, len(content) - n) + 1, max(1, n // 4))]
    for window in dict.fromkeys(windows):
        matcher.set_seqs(evidence, window)
        if min(matcher.real_quick_ratio(), matcher.quick_ratio()) > best:
            best = max(best, matcher.ratio())
        if best >= least:
            return best
    return best


def validate(df: DataFrame, evidence_col: str, content_col: str, least: float = MATCH) -> DataFrame:
    """Adds ``match_score`` and ``supported``; exact containment is found inside the JVM, only the rest goes to Python."""

    def fuzzy(evidence: pd.Series, content: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x else match_score(e, c) for e, c, x in zip(evidence, content, exact, strict=True)])

    e, c = T.normalise_evidence(F.coalesce(evidence_col, F.lit(""))), T.normalise_evidence(F.coalesce(content_col, F.lit("")))
    exact = (e != "") & c.contains(e)
    short = F.length(e) < 12
    scored = F.when(exact, 1.0).when(short, 0.0).otherwise(F.pandas_udf(fuzzy, "double")(F.when(~exact & ~short, e).otherwise(""), F.when(~exact & ~short, c).otherwise(""), exact))
    return df.withColumn("match_score", F.round(scored, 6)).withColumn("supported", F.col("match_score") >= least)


def representatives(df: DataFrame, key: Sequence[Column], id_col: str, file_rank: Column, claim: Column, order: Column) -> DataFrame:
    """(id, ``representative``, ``kept``): of equal keys the row of the best-ranked file, then the longest claim, then the first.

    Keys are made once and kept as digests beside ids, which is all that is shuffled. The representative is a minimum by key,
    combined before the shuffle and joined back, so a hot key is never collected. Rows whose last key part is
    empty stand for themselves and aren't shuffled.
    """
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    digest = F.when(parts[-1] != "", F.sha2(F.concat_ws("|", *parts), 256))
    rows = cut(df.select(F.col(id_col), digest.alias("__key"), F.struct(F.coalesce(file_rank, F.lit(UNRANKED)).alias("r"), (-F.length(claim)).alias("n"), order.alias("o")).alias("__place")))
    known = rows.filter("__key is not null")
    best = known.groupBy("__key").agg(F.min_by(F.col(id_col), "__place").alias("representative"))
    found = known.join(best, "__key").select(id_col, "representative")
    alone = rows.filter("__key is null").select(id_col, F.col(id_col).alias("representative"))
    return found.unionByName(alone).withColumn("kept", F.col("representative") == F.col(id_col))


def dedup_exact(df: DataFrame, key: Sequence[Column], id_col: str, file_rank: Column, claim: Column, order: Column) -> DataFrame:
    """Adds ``representative`` and ``kept`` (see ``representatives``) to rows whose ids are distinct."""
    return df.join(representatives(df, key, id_col, file_rank, claim, order), id_col)


def merge_contexts(*contexts: DataFrame) -> DataFrame:
    """Contexts (file_path, start_idx, end_idx, evidence_text, route, …) in order: each place and text once per route, rejected ones all."""
    every = None
    for k, c in enumerate(contexts):
        c = c.withColumn("__context", F.lit(k))
        every = c if every is None else every.unionByName(c)
    w = Window.partitionBy("route", "file_path", "start_idx", "end_idx", T.normalise_evidence("evidence_text")).orderBy("__context", "candidate_id")
    first = F.row_number().over(w)
    return every.withColumn("__k", first).filter((F.col("__k") == 1) | (F.col("route") == "rejected_evidence")).drop("__k", "__context")


#: texts of a part of a band of lengths (about), and how much longer the texts of the next band are
CELL, BAND = 1500, 1.25


def _histograms(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall into each of 64 classes."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) & 63, 1)
    return out


def similar_pairs(left: list[str], right: list[str], least: float, turned: Callable[[int, int], bool] = lambda i, j: False) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs whose ratio reaches ``least``; of ``turned`` pairs the right text comes first (the ratio depends on it). What two texts have in common is never more than their character classes have, which rules most pairs out."""
    a, b = _histograms(left), _histograms(right)
    sizes = b.sum(1)
    matcher = SequenceMatcher(None, autojunk=True)
    for i, text in enumerate(left):
        common = np.minimum(a[i], b).sum(1)
        for j in np.flatnonzero(2 * common >= least * (a[i].sum() + sizes) - 1e-9).tolist():
            matcher.set_seqs(*((right[j], text) if turned(i, j) else (text, right[j])))
            ratio = round(matcher.ratio(), 6)
            if ratio >= least:
                yield i, j, ratio


def fuzzy_links(df: DataFrame, id_col: str, text_col: str, class_col: str, least: float = 0.5, min_chars: int = 10, within: Sequence[str] = ()) -> DataFrame:
    """(a, b, similarity) of texts of ``within`` (such as a package) whose ratio, of the text of the smaller id to the other, reaches ``least``; pairs of one class link only when equal.

    Equal texts of a class are one node: their rows are linked to the one of least id.
    Nodes are dealt to bands of length, and bands to parts of about ``CELL`` texts. Two parts are compared, in a task of their own, only where
    lengths from their bands can reach ``least``; no pair is lost, and only links leave a task. For a large
    collection give ``within`` too: the comparisons grow with the square of its largest band.
    """
    kind = dict(df.dtypes)[id_col]
    key = F.concat_ws("\u0001", *within) if within else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), T.normalise_evidence(text_col).alias("t"), F.col(class_col).cast("string").alias("c"), key.alias("w")).filter(F.length("t") >= min_chars)
    nodes = cut(rows.groupBy("w", "c", "t").agg(F.min("id").alias("id")))
    copies = rows.join(nodes.withColumnRenamed("id", "a"), (rows.w == nodes.w) & (rows.t == nodes.t) & rows.c.eqNullSafe(nodes.c)).filter(F.col("a") < F.col("id")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    banded = nodes.withColumn("band", F.floor(F.log(F.greatest(F.length("t"), F.lit(1)).cast("double")) / math.log(BAND) + 1e-9).cast("int"))
    sizes = banded.groupBy("w", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))  # a row for each band
    dealt = banded.join(sizes, ["w", "band"]).withColumn("part", F.pmod(F.xxhash64("t", "c"), F.col("parts")).cast("int"))
    # the bands above one whose shortest texts are near enough to its longest
    reach = max(k for k in range(1, 200) if least <= 0 or 2 / (1 + BAND ** (k - 1)) >= least - 1e-9) if least > 0.02 else 200
    lower, upper = sizes.alias("l"), sizes.alias("u")
    meets = lower.join(upper, (F.col("l.w") == F.col("u.w")) & (F.col("u.band") >= F.col("l.band")) & (F.col("u.band") <= F.col("l.band") + reach))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = meets.select(F.col("l.w").alias("w"), F.col("l.band").alias("b1"), F.col("u.band").alias("b2"), F.col("u.parts").alias("n2"), F.explode(F.sequence(F.lit(0), F.col("l.parts") - 1)).alias("p1"))
    cells = cells.select("w", "b1", "b2", "p1", each("n2").alias("p2")).filter((F.col("b1") < F.col("b2")) | (F.col("p1") <= F.col("p2")))
    own = dealt.select(F.col("w").alias("__w"), "band", "part", "id", "t", "c")
    side = lambda band, part: own.join(cells, (F.col("__w") == F.col("w")) & (F.col("band") == F.col(band)) & (F.col("part") == F.col(part)))
    left = side("b1", "p1").select("w", "b1", "p1", "b2", "p2", "id", "t", "c")
    right = side("b2", "p2").select(F.col("w").alias("xw"), F.col("b1").alias("x1"), F.col("p1").alias("y1"), F.col("b2").alias("x2"), F.col("p2").alias("y2"), F.col("id").alias("rid"), F.col("t").alias("rt"), F.col("c").alias("rc"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(a) and len(b):
            inside = a["b1"].iloc[0] == a["b2"].iloc[0] and a["p1"].iloc[0] == a["p2"].iloc[0]
            a, b = a.sort_values("id"), b.sort_values("rid")
            ids, others, classes, theirs = (s.tolist() for s in (a["id"], b["rid"], a["c"], b["rc"]))
            for i, j, ratio in similar_pairs(a["t"].tolist(), b["rt"].tolist(), least, lambda i, j: others[j] < ids[i]):
                if (not inside or ids[i] < others[j]) and classes[i] != theirs[j]:
                    made.append((min(ids[i], others[j]), max(ids[i], others[j]), ratio))
        return pd.DataFrame(made, columns=["a", "b", "similarity"])

    found = left.groupBy("w", "b1", "p1", "b2", "p2").cogroup(right.groupBy("xw", "x1", "y1", "x2", "y2")).applyInPandas(compare, f"a {kind}, b {kind}, similarity double")
    return copies.unionByName(found)


def fuzzy_groups(links: DataFrame) -> DataFrame:
    """(node, component, ``size``, ``similarity``): the groups that links make, with the largest similarity in each."""
    own = components(links)
    best = links.join(own, links.a == own.node).groupBy("component").agg(F.max("similarity").alias("similarity"))
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(sizes, "component").join(best, "component").select("node", "component", "size", "similarity")


#: bytes of passages that are broadcast at most, and parts of the documents that meet a block of more
PASSAGE_BYTES, PASSAGE_SALTS = 4 << 20, 64


def find_passages(docs: DataFrame, passages: DataFrame, doc_id: str, doc_text: str, item_id: str, passage: str) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage, both in their normal form.

    A term inside a passage, neither its first nor its last, is a whole term of every text
    that holds it: documents are found by the longest one. Passages without such a term are compared with all documents:
    broadcast if they have at most ``PASSAGE_BYTES`` together, else dealt to blocks of that size, which meet the documents
    in tasks of their own.
    """
    whole = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")
    norm = passages.select(item_id, T.normalise_evidence(passage).alias("__e")).filter("__e <> ''")
    inner = F.filter(F.slice(whole(F.col("__e")), 2, F.greatest(F.lit(0), F.size(whole(F.col("__e"))) - 2)), lambda x: F.length(x) >= 3)
    best = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    marks = cut(norm.select(item_id, "__e", best.alias("__term")))
    own = docs.select(doc_id, F.explode(F.array_distinct(whole(T.normalise_evidence(doc_text)))).alias("__term"))
    named = marks.filter("__term is not null")
    hits = own.join(named.select("__term").distinct(), "__term", "left_semi").join(named.select("__term", item_id), "__term").select(doc_id, item_id).distinct()
    texts = docs.select(doc_id, T.normalise_evidence(doc_text).alias("__t"))
    found = hits.join(texts, doc_id).join(norm, item_id)
    short = marks.filter("__term is null").select(item_id, "__e")
    blocks = -(-(short.agg(F.sum(F.octet_length("__e"))).first()[0] or 0) // PASSAGE_BYTES)
    if blocks > 1:
        dealt = short.select(item_id, "__e", F.pmod(F.xxhash64(item_id), F.lit(blocks)).alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(PASSAGE_SALTS - 1))).alias("__s"))
        every = texts.select(doc_id, "__t", F.pmod(F.xxhash64(doc_id), F.lit(PASSAGE_SALTS)).cast("int").alias("__s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long").alias("__b"))
        tried = every.join(dealt, ["__b", "__s"])
    else:
        tried = texts.join(F.broadcast(short))
    both = [x.filter(F.col("__t").contains(F.col("__e"))).select(doc_id, item_id) for x in (found, tried)]
    return (both[0].union(both[1]) if blocks else both[0]).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): least node reachable, by minima over neighbours with pointer jumping and a checkpoint a round."""
    e = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = cut(e.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(labels.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("new"))
        jumped = hooked.join(labels.select(F.col("node").alias("new"), F.col("component").alias("far")), "new", "left")
        after = cut(jumped.select("node", F.col("component").alias("old"), F.least("new", F.coalesce("far", "new")).alias("component")))
        done = after.filter("old <> component").isEmpty()
        labels = after.select("node", "component")
        if done:
            return labels


def window_neighbours(df: DataFrame, key: str, id_col: str, start: str, end: str, near: int) -> DataFrame:
    """(id, other) of rows of one key whose spans overlap or whose starts or ends lie within ``near``.

    Rows are dealt to cells of the start; a span is looked for only in the cells it
    can touch, so a key with many rows is spread over its cells.
    """
    width = max(1, near) * 8
    base = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    cells = base.withColumn("cell", F.explode(F.sequence(F.floor((F.col("s") - near) / width).cast("long"), F.floor((F.greatest("s", "e") + near) / width).cast("long"))))
    home = base.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / width).cast("long"), F.floor(F.greatest("s", "e") / width).cast("long")))))
    a, b = cells.alias("a"), home.alias("b")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") != F.col("b.id"))
    overlap = (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    close = (F.abs(F.col("a.s") - F.col("b.s")) <= near) | (F.abs(F.col("a.e") - F.col("b.e")) <= near)
    one = a.join(b, same & (overlap | close)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    return one.union(one.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()


def band_counts(df: DataFrame, key: str, at: str, reach: int, name: str = "n_near") -> DataFrame:
    """Rows of the same key whose ``at`` lies within ``reach``, itself not counted: a range frame, no pairs."""
    w = Window.partitionBy(key).orderBy(F.col(at)).rangeBetween(-reach, reach)
    return df.withColumn(name, F.count("*").over(w) - 1)


#: How much evidence a requirement takes, and with how much context.
LIMITS = {
    "attribute_range_decomposition": (3, 0), "attribute_parent_placement": (4, 2), "dataset_title_identity": (3, 1), "dataset_description_scope": (3, 1),
    "generation_activity_reality": (3, 2), "technical_agent_kind": (3, 2), "method_plan_presence": (3, 2), "activity_evaluation_target": (4, 2),
}


def score_requirements(candidates: DataFrame, requirements: DataFrame, text_col: str, tie: Sequence[str], limit: int = 5) -> DataFrame:
    """(requirement_id, score, candidate columns, position): candidates by how many hints they hold, at most ``limit`` a requirement, or as many as ``LIMITS`` has for it.

    Requirements are a small catalogue; hints are exploded and joined to the
    candidates' own terms, so only pairs with a shared hint come about.
    """
    hints = requirements.select("requirement_id", F.explode(F.array_distinct(F.flatten(F.transform("hints", lambda h: T.terms(h))))).alias("term"))
    own = candidates.withColumn("__term", F.explode(F.array_distinct(T.terms(text_col))))
    hit = own.join(hints, own["__term"] == hints["term"]).groupBy("requirement_id", *tie).agg(F.count("*").alias("score"))
    w = Window.partitionBy("requirement_id").orderBy(F.desc("score"), *tie)
    most = F.lit(limit)
    for name, (n, _) in LIMITS.items():
        most = F.when(F.col("requirement_id") == name, n).otherwise(most)
    ranked = hit.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= max(limit, *(n for n, _ in LIMITS.values())))
    return ranked.filter(F.col("position") <= most)


def class_points(target: Column, category: Column, role: Column, text: Column) -> Column:
    """Points for a candidate's fit to a target class."""
    has = lambda *words: text.rlike("|".join(words))
    quantity = (category.isin("instrument_signal", "measurement_condition")) | (role == "parameter")
    more = has("frequency", "temperature", "width", "count", "points", "range", "axis", "threshold", "unit", "setting", "parameter").cast("int")
    less = has("formula", "subrange", "range of", r"0\.\.", "rel ").cast("int")
    cue = text.rlike(r"\b(method|procedure|protocol|plan|sampling|acquisition)\b")
    return (
        F.when((target == "DataGeneratingActivity") & ((category == "activity_signal") | has("acquisition", "processing", "experiment")), 2)
        .when((target == "AgenticEntity") & (category.isin("software_signal", "instrument_signal") | has("instrument", "software", "device", "equipment", "sensor")), 2)
        .when((target == "EvaluatedEntity") & (category == "activity_signal"), 2)
        .when((target == "Distribution") & ((category == "resource_signal") | has("file", "format", "download")), 2)
        .when((target == "Plan") & ((category == "method_signal") | cue), 2)
        .when((target == "QuantitativeAttribute") & quantity, 2 + more - less)
        .otherwise(0)
    )


#: The two vocabularies that a swapped record confuses.
CATEGORIES = ("activity_signal", "instrument_signal", "software_signal", "measurement_condition", "measurement_signal", "method_signal", "resource_signal", "sample_signal", "other_signal")
ROLES = ("identity", "parameter", "description", "relation", "value", "context")


def repair_swapped(category: Column, role: Column) -> tuple[Column, Column]:
    """Category and role, exchanged where each holds a value of the other."""
    swapped = category.isin(*ROLES) & role.isin(*CATEGORIES)
    return F.when(swapped, role).otherwise(category), F.when(swapped, category).otherwise(role)


def buckets(df: DataFrame, keys: Sequence[Column], order: Column, size: int = 6) -> DataFrame:
    """Groups of at most ``size`` rows of equal keys, numbered."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def first_wins(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def select_by_ids(ids: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for (position, candidate_id) rows: missing ids are dropped, each id stands once, where it came first."""
    return first_wins(ids, ["candidate_id"], ["position"]).join(candidates, "candidate_id")

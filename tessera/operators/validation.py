"""JSON Schema validation as a plan: documents become rows of nodes, a schema becomes a table of constraints, and they are joined.

A node's ``pattern`` is its pointer with ``*`` for places in arrays and ``+`` for
properties that the schema doesn't name; constraints are joined on it. What ``anyOf``
and ``oneOf`` allow is decided by how many alternatives have no issue below the
node, from the innermost group outwards. Only parts that the schema speaks of
are taken apart. Nothing runs in Python but the reading of the schema.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoint import cut

#: how often a definition may stand inside itself
DEPTH = 12

_CONSTRAINT = "id int, pattern string, kind string, schema_path string, said string, number double, names array<string>, numbers array<double>, texts array<string>, scope array<struct<g:int,a:int,depth:int>>, alternatives int"
_BOUNDS = {
    "minimum": "less than the minimum of",
    "maximum": "greater than the maximum of",
    "exclusiveMinimum": "less than or equal to the minimum of",
    "exclusiveMaximum": "greater than or equal to the maximum of",
}
_SIZES = {"minLength": "string", "maxLength": "string", "minItems": "array", "maxItems": "array", "minProperties": "object", "maxProperties": "object"}


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


@dataclass
class Constraints:
    """A schema as rows; ``patterns`` are those that it speaks of."""

    schema: dict
    depth: int = DEPTH
    rows: list[tuple] = field(default_factory=list)
    patterns: set[str] = field(default_factory=lambda: {""})

    def __post_init__(self):
        self.open: list[tuple] = []
        self._walk(self.schema, "", "", (), ())
        done = 0
        while done < len(self.open):  # unnamed properties of one part may be named by another
            sub, pattern, path, scope, refs, own = self.open[done]
            done += 1
            for other in sorted(self.patterns):
                key = other.removeprefix(f"{pattern}/")
                if other.startswith(f"{pattern}/") and "/" not in key and key not in ("*", "+") and key not in own:
                    self._walk(sub, other, path, scope, refs)

    def _add(self, pattern, kind, path, scope, said="", number=None, names=(), numbers=(), texts=(), alternatives=None):
        self.rows.append((len(self.rows), pattern, kind, path, said, None if number is None else float(number), list(names), [float(x) for x in numbers], list(texts), [list(s) for s in scope], alternatives))
        return len(self.rows) - 1

    def _resolved(self, ref: str):
        node = self.schema
        for part in ref.removeprefix("#").split("/")[1:]:
            node = node[part.replace("~1", "/").replace("~0", "~")]
        return node

    def _walk(self, node, pattern: str, path: str, scope: tuple, refs: tuple) -> None:
        self.patterns.add(pattern)
        if node is False:
            self._add(pattern, "never", path, scope)
        if not isinstance(node, dict):
            return
        if ref := node.get("$ref"):
            if not ref.startswith("#"):
                raise ValueError(f"a reference out of the schema: {ref}")
            if refs.count(ref) < self.depth:
                self._walk(self._resolved(ref), pattern, f"{path}/$ref", scope, (*refs, ref))
        if "type" in node:
            kinds = node["type"] if isinstance(node["type"], list) else [node["type"]]
            self._add(pattern, "type", f"{path}/type", scope, ", ".join(f"'{k}'" for k in kinds), names=kinds)
        for kind, values in (("enum", node.get("enum")), ("const", [node["const"]] if "const" in node else None)):
            if values is not None:
                number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
                self._add(pattern, kind, f"{path}/{kind}", scope, json.dumps(values[0] if kind == "const" else values, ensure_ascii=False), numbers=[v for v in values if number(v)], texts=[json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values if not number(v)])
        for kind in (*_BOUNDS, *_SIZES):
            if kind in node:
                self._add(pattern, kind, f"{path}/{kind}", scope, json.dumps(node[kind]), node[kind])
        if "pattern" in node:
            self._add(pattern, "pattern", f"{path}/pattern", scope, node["pattern"])
        for key in node.get("required", ()):
            self._add(pattern, "required", f"{path}/required", scope, key)
        named = node.get("properties", {})
        for key, sub in named.items():
            self._walk(sub, f"{pattern}/{escaped(key)}", f"{path}/properties/{escaped(key)}", scope, refs)
        other = node.get("additionalProperties", True)
        if other is False:
            self._add(pattern, "additionalProperties", f"{path}/additionalProperties", scope, names=list(named))
        elif isinstance(other, dict) and other:
            self._walk(other, f"{pattern}/+", f"{path}/additionalProperties", scope, refs)
            self.open.append((other, pattern, f"{path}/additionalProperties", scope, refs, {escaped(k) for k in named}))
        if "items" in node:
            self._walk(node["items"], f"{pattern}/*", f"{path}/items", scope, refs)
        for k, sub in enumerate(node.get("allOf", ())):
            self._walk(sub, pattern, f"{path}/allOf/{k}", scope, refs)
        for kind in ("anyOf", "oneOf"):
            if kind in node:
                group = self._add(pattern, kind, f"{path}/{kind}", scope, alternatives=len(node[kind]))
                for k, sub in enumerate(node[kind]):
                    self._walk(sub, pattern, f"{path}/{kind}/{k}", (*scope, (group, k, pattern.count("/"))), refs)

    @property
    def levels(self) -> int:
        return max((len(r[9]) for r in self.rows), default=0) + 1 if any(r[10] for r in self.rows) else 0


def _children(n: Column, below: list[str]) -> Column:
    """Those children of the node ``n`` that have one of the patterns ``below``, as an array of nodes."""
    v = n["v"]

    def made(step: Column, pattern: Column, value: Column) -> Column:
        return F.struct(n["id"].alias("id"), F.concat_ws("/", n["pointer"], step).alias("pointer"), pattern.alias("pattern"), value.alias("v"))

    def named(x: Column) -> Column:
        key = F.replace(F.replace(x["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        pattern = F.concat_ws("/", n["pattern"], key)
        return made(key, F.when(pattern.isin(*below), pattern).otherwise(F.concat(n["pattern"], F.lit("/+"))), x["value"])

    def placed(value: Column, k: Column) -> Column:
        return made(k.cast("string"), F.concat(n["pattern"], F.lit("/*")), value)

    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), named)
    places = F.transform(F.try_variant_get(v, "$", "array<variant>"), placed)
    return F.filter(F.coalesce(fields, places, F.array_repeat(n, 0)), lambda x: x["pattern"].isin(*below))


def nodes(df: DataFrame, id_col: str, json_col: str, patterns: set[str]) -> DataFrame:
    """``id``, ``pointer``, ``pattern`` and the variant ``v`` of every node with one of ``patterns``; ``v`` is null where the text is no JSON.

    A document is parsed once: each step adds the children of the nodes of one depth to the rows of the step before, in the same task.
    """
    root = F.struct(F.col(id_col).alias("id"), F.lit("").alias("pointer"), F.lit("").alias("pattern"), F.try_parse_json(F.col(json_col)).alias("v"))
    level, n = df.select(root.alias("n")), F.col("n")
    for depth in range(max(p.count("/") for p in patterns)):
        below = sorted(p for p in patterns if p.count("/") == depth + 1)
        above = sorted({p.rsplit("/", 1)[0] for p in below})
        level = level.select(F.explode(F.when(F.col("n.pattern").isin(*above), F.concat(F.array(n), _children(n, below))).otherwise(F.array(n))).alias("n"))
    return level.select("n.*")


def _kind(text: Column) -> Column:
    """The JSON type that a value's text begins; numbers without a fraction are integers."""
    first, number = F.substring(text, 1, 1), text.try_cast("double")
    plain = F.when(first == "n", "null").when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean")
    return plain.when(number == F.floor(number), "integer").when(text.isNotNull(), "number")


def issues(df: DataFrame, id_col: str, json_col: str, schema: dict, depth: int = DEPTH) -> DataFrame:
    """``id_col``, ``path`` (pointer), ``schema_path`` and ``message`` of everything in a JSON column that a schema doesn't allow.

    Types, enum, const, bounds, sizes, pattern (anywhere in the string), required, properties, additionalProperties, items,
    allOf, anyOf, oneOf and references within the schema count, which may be recursive up to ``depth`` times. A text that is
    no JSON has one issue; a null text has none. Words of messages are those of the usual validators.
    """
    spark, made = df.sparkSession, Constraints(schema, depth)
    made._add("", "json", "", ())
    table = F.broadcast(spark.createDataFrame(made.rows, _CONSTRAINT))  # as many rows as the schema has keywords
    kind = F.col("t")
    texts = df.select(id_col, json_col).filter(F.col(json_col).isNotNull())
    # texts are small for what is done with them, so adaptive execution would give them to few tasks
    texts = texts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), id_col)
    every = nodes(texts, id_col, json_col, made.patterns).filter(F.col("pattern").isin(*{r[1] for r in made.rows}))
    seen = every.withColumn("text", F.to_json("v")).withColumn("t", _kind(F.col("text"))).select(
        "id", "pointer", "pattern", "text", "t",
        F.when(kind.isin("integer", "number"), F.try_variant_get("v", "$", "double")).alias("value"),
        F.when(kind == "string", F.try_variant_get("v", "$", "string")).alias("string"),
    )
    both = seen.join(table.withColumnRenamed("id", "g"), "pattern")
    of, number = F.col("kind"), F.col("number")
    keys, items = F.when(kind == "object", F.json_object_keys("text")), F.when(kind == "array", F.json_array_length("text"))
    size = F.coalesce(F.when(of.endswith("Length"), F.length("string")), F.when(of.endswith("Items"), items), F.when(of.endswith("Properties"), F.size(keys)))
    size = F.when(of.isin(*_SIZES), size)
    extra = F.array_except(keys, F.col("names"))
    fits = F.array_contains("names", F.col("t")) | (F.col("t") == "integer") & F.array_contains("names", F.lit("number"))
    listed = F.coalesce(F.array_contains("numbers", F.col("value")), F.array_contains("texts", F.col("text")))
    wrong = (
        F.when(F.col("text").isNull() | (of == "json"), F.col("text").isNull() & (of == "json"))
        .when(of == "never", True)
        .when(of == "type", ~fits)
        .when(of.isin("enum", "const"), ~listed)
        .when(of == "required", ~F.array_contains(keys, F.col("said")))
        .when(of == "additionalProperties", F.size(extra) > 0)
        .when(of == "pattern", ~F.rlike("string", F.col("said")))
        .when(of == "minimum", F.col("value") < number)
        .when(of == "maximum", F.col("value") > number)
        .when(of == "exclusiveMinimum", F.col("value") <= number)
        .when(of == "exclusiveMaximum", F.col("value") >= number)
        .when(of.startswith("min"), size < number)
        .when(of.startswith("max"), size > number)
    )
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shown = F.when(kind == "string", say("'", F.col("string"), "'")).otherwise(F.col("text"))
    bound = F.create_map(*(F.lit(x) for pair in _BOUNDS.items() for x in pair))
    message = (
        F.when(of == "json", "not JSON")
        .when(of == "never", say("False schema does not allow ", shown))
        .when(of == "type", say(shown, " is not of type ", F.col("said")))
        .when(of == "enum", say(shown, " is not one of ", F.col("said")))
        .when(of == "const", say(F.col("said"), " was expected"))
        .when(of == "required", say("'", F.col("said"), "' is a required property"))
        .when(of == "additionalProperties", say("Additional properties are not allowed (", F.array_join(F.transform(F.array_sort(extra), lambda k: say("'", k, "'")), ", "), F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)")))
        .when(of == "pattern", say(shown, " does not match '", F.col("said"), "'"))
        .when(of.isin(*_BOUNDS), say(shown, " is ", bound[of], " ", F.col("said")))
        .when(of.isin("minLength"), say(shown, " is too short"))
        .when(of.isin("maxLength"), say(shown, " is too long"))
        .when(of.startswith("min"), say(shown, " does not have enough ", F.when(of == "minItems", "items").otherwise("properties")))
        .otherwise(say(shown, " has too many ", F.when(of == "maxItems", "items").otherwise("properties")))
    )
    group = of.isin("anyOf", "oneOf")
    kept = both.filter(F.coalesce(wrong, F.lit(False)) | group & F.col("text").isNotNull())
    # what is wrong, and the nodes of groups: few of all, found once, for every level below asks for them again
    marks = cut(kept.select("id", F.col("pointer").alias("path"), "schema_path", F.when(~group, message).alias("message"), "scope", "kind", F.when(group, shown).alias("shown"), "alternatives", "g"))
    found = marks.filter(~group).select("id", "path", "schema_path", "message", "scope")
    groups = marks.filter(group).drop("message")
    for level in range(made.levels, 0, -1):
        top = F.try_element_at("scope", F.lit(-1))
        inner = found.filter(F.size("scope") == level).select("id", F.array_join(F.slice(F.split("path", "/"), F.lit(1), top["depth"] + 1), "/").alias("path"), top["g"].alias("g"), top["a"].alias("a"))
        failed = inner.groupBy("id", "path", "g").agg(F.count_distinct("a").alias("failed"))
        here = groups.filter(F.size("scope") == level - 1).join(failed, ["id", "path", "g"], "left").withColumn("passed", F.col("alternatives") - F.coalesce("failed", F.lit(0)))
        none = F.when(F.col("kind") == "anyOf", say(F.col("shown"), " is not valid under any of the given schemas"))
        said = none.when(F.col("passed") == 0, say(F.col("shown"), " is not valid under any of the given schemas")).otherwise(say(F.col("shown"), " is valid under each of the alternatives"))
        lost = here.filter((F.col("passed") == 0) | (F.col("kind") == "oneOf") & (F.col("passed") > 1)).select("id", "path", "schema_path", said.alias("message"), "scope")
        found = found.filter(F.size("scope") < level).unionByName(lost)
    return found.filter(F.size("scope") == 0).select(F.col("id").alias(id_col), "path", "schema_path", "message")

"""Operators over columns of JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonpointer as J


def leaf_paths(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, pointer, type, value) of every leaf; documents that aren't JSON give one leaf of type ``invalid``."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    own = J.leaves(json.loads(text))
                except ValueError:
                    own = [("", "invalid", text)]
                places += [k] * len(own)
                rows += own
            if rows:
                columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], names=["id", "pointer", "type", "value"])

    return df.select(id_col, json_col).mapInArrow(run, f"id {kind}, pointer string, type string, value string")


def diff(generated: DataFrame, curated: DataFrame) -> DataFrame:
    """(id, pointer, status) over the leaves of two versions: auto_removed, added, auto_modified or unchanged."""
    g = generated.select("id", "pointer", F.col("value").alias("old"))
    c = curated.select("id", "pointer", F.col("value").alias("new"))
    status = F.when(F.col("new").isNull(), "auto_removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "auto_modified").otherwise("unchanged")
    return g.join(c, ["id", "pointer"], "full_outer").withColumn("status", status)


def coverage_counts(expected: DataFrame, leaves: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Expected (id, pointer) against present leaves: ``filled``, ``total``, ``ratio``; empty values don't fill."""
    present = leaves.filter(~F.col("value").isin('""', "null", "[]", "{}")).select("id", "pointer").distinct().withColumn("__p", F.lit(1))
    return expected.join(present, ["id", "pointer"], "left").groupBy(*keys).agg(F.count("__p").alias("filled"), F.count("*").alias("total")).withColumn("ratio", F.round(F.col("filled") / F.col("total"), 6))



def parsed(text: str | None):
    """The JSON value, or ``J.MISSING`` for null and what isn't JSON."""
    try:
        return J.MISSING if text is None else json.loads(text)
    except ValueError:
        return J.MISSING


def get_pointer(doc: Column, pointer: Column) -> Column:
    """The value at a pointer as JSON text, null where there is none or the document isn't JSON."""

    def f(d: pd.Series, p: pd.Series) -> pd.Series:
        found = [J.MISSING if b is None or (a := parsed(text)) is J.MISSING else J.get(a, b, J.MISSING) for text, b in zip(d, p, strict=True)]
        return pd.Series([None if x is J.MISSING else json.dumps(x, sort_keys=True) for x in found], dtype=object)

    return F.pandas_udf(f, "string")(doc, pointer)


def apply_writes(doc: Column, writes: Column) -> Column:
    """struct(document, changed, error) after a JSON list of writes; a failed list leaves the document as it was."""

    def f(d: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(d, w, strict=True):
            try:
                made, changed = J.apply_writes(json.loads(a), json.loads(b))
                rows.append((json.dumps(made, sort_keys=True), changed, None))
            except (ValueError, KeyError, TypeError) as e:
                rows.append((a, [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["document", "changed", "error"])

    return F.pandas_udf(f, "document string, changed array<string>, error string")(doc, writes)


def clean(doc: Column) -> Column:
    """Documents without missing values, keys sorted; null for what isn't JSON."""

    def f(d: pd.Series) -> pd.Series:
        return pd.Series([None if (a := parsed(text)) is J.MISSING else json.dumps(J.without_missing(a), sort_keys=True) for text in d], dtype=object)

    return F.pandas_udf(f, "string")(doc)


def validation_issues(doc: Column, schema: dict) -> Column:
    """array<struct(pointer, message)> of violations of ``schema``; a text that isn't JSON has one, a null none."""

    def f(d: pd.Series) -> pd.Series:
        def issues(text: str | None) -> list[tuple[str, str]]:
            a = parsed(text)
            return J.validate(a, schema) if a is not J.MISSING else [] if text is None else [("", "not JSON")]

        return pd.Series([[{"pointer": p, "message": m} for p, m in issues(text)] for text in d], dtype=object)

    return F.pandas_udf(f, "array<struct<pointer:string,message:string>>")(doc)


def to_triples(leaves: DataFrame, base: str, context: dict[str, str]) -> DataFrame:
    """Leaves as (s, p, o): the pointer's last name, mapped by ``context``, about the document; nulls are left out."""
    name = F.element_at(F.filter(F.split("pointer", "/"), lambda x: ~x.rlike(r"^\d*$")), -1)
    mapped = F.lit(None).cast("string")
    for k, iri in sorted(context.items()):
        mapped = F.when(name == k, F.lit(iri)).otherwise(mapped)
    kept = leaves.filter(~F.col("type").isin("null", "invalid", "array", "object"))
    return kept.select(F.concat(F.lit(base), F.col("id").cast("string")).alias("s"), mapped.alias("p"), F.regexp_replace("value", '^"|"$', "").alias("o")).filter("p is not null")


def group_attributes(df: DataFrame, parent: str, order: str, label: str, value: str, rel: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """(parent, order, ``group``): attributes of a parent join the first group whose first member has their label and an equal value.

    The comparison is with first members only, so it depends on the order; each
    parent's attributes are one row, and many parents go to Python in one batch.
    """

    def number(items: pd.Series) -> pd.Series:
        out = []
        for row in items:
            firsts: dict[str, list[tuple[float, int]]] = {}
            groups, n = [], 0
            for x in row:
                known = firsts.setdefault(x["label"], [])
                v = x["value"]
                hit = next((g for w, g in known if abs(w - v) <= max(rel * max(abs(w), abs(v)), absolute)), None)
                if hit is None:
                    hit, n = n, n + 1
                    known.append((v, hit))
                groups.append(hit)
            out.append(groups)
        return pd.Series(out, dtype=object)

    rows = df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(label).alias("label"), F.col(value).cast("double").alias("value")))).alias("items"))
    numbered = rows.select(parent, "items", F.pandas_udf(number, "array<long>")("items").alias("groups"))
    return numbered.select(parent, F.explode(F.arrays_zip("items", "groups")).alias("x")).select(parent, F.col("x.items.at").alias(order), F.col("x.items.label").alias(label), F.col("x.items.value").alias(value), F.col("x.groups").alias("group"))


def changed(doc: Column, change: Callable, *args) -> Column:
    """``change(document, *args)`` of each document as JSON with its keys in their order; null for what isn't JSON."""

    def f(d: pd.Series) -> pd.Series:
        return pd.Series([None if (a := parsed(text)) is J.MISSING else json.dumps(change(a, *args)) for text in d], dtype=object)

    return F.pandas_udf(f, "string")(doc)


def patched(doc: Column, operations: Column) -> Column:
    """struct(document, error) after a JSON list of JSON Patch operations; a failed list leaves the document as it was."""
    from tessera.functions.drafts import apply_patch

    def f(d: pd.Series, o: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(d, o, strict=True):
            try:
                rows.append((json.dumps(apply_patch(json.loads(a), json.loads(b)), sort_keys=True), None))
            except (ValueError, KeyError, TypeError) as e:
                rows.append((a, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["document", "error"])

    return F.pandas_udf(f, "document string, error string")(doc, operations)

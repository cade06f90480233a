"""Validation as a plan, against a plain recursive validator."""

import json
import random
import re

from tessera.operators import validation as V

SCHEMA = {
    "type": "object",
    "required": ["id", "items"],
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100},
        "name": {"type": ["string", "null"], "minLength": 2, "maxLength": 5, "pattern": "^[a-z]"},
        "state": {"enum": ["open", "done", 3, None, True]},
        "kind": {"const": "order"},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/item"}},
        "a/b~c": {"type": "boolean"},
        "who": {"anyOf": [{"type": "string"}, {"type": "object", "required": ["name"], "properties": {"name": {"oneOf": [{"type": "string", "maxLength": 3}, {"type": "string", "pattern": "x"}]}}}]},
        "tree": {"$ref": "#/$defs/tree"},
        "map": {"type": "object", "additionalProperties": {"type": "number"}, "maxProperties": 2},
        "both": {"allOf": [{"properties": {"p": {"type": "string"}}}, {"properties": {"q": {"type": "string"}}, "additionalProperties": {"minLength": 3}}]},
    },
    "additionalProperties": False,
    "$defs": {
        "item": {"type": "object", "properties": {"n": {"type": "number", "maximum": 10.5}}, "required": ["n"], "additionalProperties": False},
        "tree": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}, "v": {"type": "string"}}},
    },
}


def plain(node, schema, path="", at=""):
    """(path, schema path) of all issues."""
    out = []
    if schema is False:
        return [(path, at)]
    if not isinstance(schema, dict):
        return []
    if "$ref" in schema:
        target = SCHEMA
        for part in schema["$ref"].split("/")[1:]:
            target = target[part]
        out += plain(node, target, path, at + "/$ref")
    number = isinstance(node, (int, float)) and not isinstance(node, bool)
    is_a = {
        "object": isinstance(node, dict), "array": isinstance(node, list), "string": isinstance(node, str), "boolean": isinstance(node, bool), "null": node is None,
        "integer": number and node == int(node), "number": number,
    }
    same = lambda a, b: type(a) is type(b) and a == b or number and isinstance(b, (int, float)) and not isinstance(b, bool) and a == b
    fail = lambda k: out.append((path, f"{at}/{k}"))
    for k, x in schema.items():
        size = len(node) if isinstance(node, (str, list, dict)) else None
        if k == "type" and not any(is_a[t] for t in ([x] if isinstance(x, str) else x)):
            fail(k)
        if k == "enum" and not any(same(node, v) for v in x) or k == "const" and not same(node, x):
            fail(k)
        if number and (k == "minimum" and node < x or k == "maximum" and node > x or k == "exclusiveMinimum" and node <= x or k == "exclusiveMaximum" and node >= x):
            fail(k)
        for kind, word in ((str, "Length"), (list, "Items"), (dict, "Properties")):
            if isinstance(node, kind) and (k == f"min{word}" and size < x or k == f"max{word}" and size > x):
                fail(k)
        if k == "pattern" and isinstance(node, str) and not re.search(x, node):
            fail(k)
        if isinstance(node, dict):
            known = schema.get("properties", {})
            if k == "required":
                out += [(path, f"{at}/required") for key in x if key not in node]
            if k == "properties":
                for key, sub in x.items():
                    if key in node:
                        out += plain(node[key], sub, f"{path}/{V.escaped(key)}", f"{at}/properties/{V.escaped(key)}")
            if k == "additionalProperties":
                rest = [key for key in node if key not in known]
                if x is False and rest:
                    fail(k)
                if isinstance(x, dict):
                    for key in rest:
                        out += plain(node[key], x, f"{path}/{V.escaped(key)}", f"{at}/{k}")
        if k == "items" and isinstance(node, list):
            for n, v in enumerate(node):
                out += plain(v, x, f"{path}/{n}", f"{at}/items")
        if k == "allOf":
            for n, sub in enumerate(x):
                out += plain(node, sub, path, f"{at}/allOf/{n}")
        if k in ("anyOf", "oneOf"):
            good = sum(not plain(node, sub, path) for sub in x)
            if good == 0 or k == "oneOf" and good > 1:
                fail(k)
    return out


def random_document(r, depth=0):
    value = lambda: r.choice((1, 0, 99, 100, 2.5, 3.0, 11, "abc", "x", "Order", "order", "open", "abcdefg", "", None, True, False, [], {}, [1], {"n": 1}, {"name": "ax"}, {"name": "abcd"}, {"name": "ab"}, {"name": 3}))
    tree = lambda d: r.choice((value(), {"kids": [tree(d + 1) for _ in range(r.randrange(3))], "v": r.choice(("s", 1))})) if d < 4 else {}
    made = {
        "id": value, "name": value, "state": value, "kind": value, "a/b~c": value, "who": value, "more": value, "tree": lambda: tree(0),
        "items": lambda: r.choice(([], value(), [{"n": r.choice((1, 10.5, 11, "x"))} for _ in range(r.randrange(5))], [{"n": 1, "z": 2}, {}, 3])),
        "map": lambda: {k: value() for k in r.sample(["a", "b/c", "d"], r.randrange(4))},
        "both": lambda: {k: value() for k in r.sample(["p", "q", "r"], r.randrange(4))},
    }
    good = {"id": 5, "name": "abc", "state": "open", "kind": "order", "items": [{"n": 1}], "who": "w"}
    out = {k: good[k] if k in good and r.random() < 0.5 else f() for k, f in made.items() if r.random() < 0.7}
    return value() if r.random() < 0.03 else good | {"tree": {"kids": [{"v": "s"}]}} if r.random() < 0.1 else out


def test_issues_equal_a_plain_validator(spark):
    r = random.Random(9)
    docs = [random_document(r) for _ in range(400)]
    rows = [(k, json.dumps(d, ensure_ascii=False)) for k, d in enumerate(docs)]
    df = spark.createDataFrame([*rows, (1000, "{broken"), (1001, None), (1002, "")], "k long, j string")
    got, want = {}, {k: sorted(plain(d, SCHEMA)) for k, d in enumerate(docs)}
    for x in V.issues(df, "k", "j", SCHEMA).collect():
        got.setdefault(x.k, []).append((x.path, x.schema_path))
    assert got.pop(1000) == got.pop(1002) == [("", "")] and 1001 not in got
    assert sum(map(len, want.values())) > 1000 and sum(not w for w in want.values()) > 3
    for k in want:
        assert sorted(got.get(k, [])) == want[k], docs[k]


def test_messages_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, json.dumps({"id": 0, "name": "A", "items": [{"n": 12, "z": 1, "y": 2}], "kind": "k", "who": 3}))], "k long, j string")
    found = V.issues(df, "k", "j", SCHEMA)
    assert {(r.path, r.message) for r in found.collect()} == {
        ("/id", "0 is less than the minimum of 1"), ("/name", "'A' is too short"), ("/name", "'A' does not match '^[a-z]'"), ("/items/0/n", "12 is greater than the maximum of 10.5"),
        ("/items/0", "Additional properties are not allowed ('y', 'z' were unexpected)"), ("/kind", '"order" was expected'), ("/who", "3 is not valid under any of the given schemas"),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert V.issues(df, "k", "j", {}).collect() == [] and [r.path for r in V.issues(df, "k", "j", {"properties": {"id": False}}).collect()] == ["/id"]


def test_documents_are_read_once(spark):
    sc = spark.sparkContext
    read = sc.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(1, '{"id": 0, "items": [{"n": 11}], "who": 5, "state": null}'), (2, "no JSON"), (3, None), (4, '{"id": 1, "items": [{"n": 1}]}')]
    df = spark.createDataFrame(sc.parallelize(rows, 2).map(seen), "doc int, body string")
    found = sorted((r["doc"], r["path"], r["schema_path"]) for r in V.issues(df, "doc", "body", SCHEMA).collect())
    assert found == [(1, "/id", "/properties/id/minimum"), (1, "/items/0/n", "/properties/items/items/$ref/properties/n/maximum"), (1, "/who", "/properties/who/anyOf"), (2, "", "")]
    assert read.value == len(rows)

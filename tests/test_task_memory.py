"""Steps whose tasks hold no more as tables grow: few sorts, no join that meets a group twice, and tasks by the number of rows."""

from __future__ import annotations

from tessera.operators import curation as K
from tessera.operators import graph as G
from tessera.operators import ledgers as L
from tessera.plans import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scheme_profile_sorts_neither_nodes_nor_edges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([("a", ["T"]), ("b", ["T", "U"]), ("c", ["T"]), ("d", [])], "uri string, rdf_types array<string>")
        edges = spark.createDataFrame([("a", "p", "c"), ("a", "p", "c"), ("c", "q", "a"), ("x", "r", "b"), ("a", None, "b")], "s string, p string, o string")
        members = spark.createDataFrame([("v", "a"), ("v", "a"), ("v", "c"), ("w", "b"), ("w", "d"), ("w", "gone"), (None, "a")], "identifier string, uri string")
        held = G.import_membership(members, nodes)
        made = G.scheme_profile(held, nodes, edges)
        assert "SortMergeJoin" not in plan(held) and plan(made).count("SortMergeJoin") <= 1  # of the counts, a row for each type
        assert sorted(map(tuple, made.collect())) == [("v", "T", 2, ["p", "q"]), ("w", "T", 1, ["r"]), ("w", "U", 1, ["r"])]
        bare = G.scheme_profile(members.filter("identifier = 'w'"), nodes, edges.filter("p = 'p'"))
        assert sorted(map(tuple, bare.collect())) == [("w", "T", 1, []), ("w", "U", 1, [])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_misplaced_attributes_join_no_words(spark):
    own, theirs = "/was_generated_by/0/has_quantitative_attribute", "/was_generated_by/0/evaluated_entity/1/has_quantitative_attribute"
    rows = [(1, own, 0, "large flow rate"), (1, own, 1, "flow of the pump"), (1, theirs, 0, "Flow rate"), (1, theirs, 0, "rate"), (2, own, 0, "flow rate"), (None, own, 0, "flow rate"), (None, theirs, 0, "flow rate")]
    made = K.misplaced_attributes(spark.createDataFrame(rows, "id long, array string, index int, label string"))
    assert "Join" not in plan(made)
    assert [tuple(r) for r in made.collect()] == [(1, "/was_generated_by/0", 0)]


def test_cross_parent_duplicates_join_no_runs(spark):
    rows = [(1, 0, "/a", "x", 1.0, "m", 1), (1, 1, "/b", "x", 1.0 + 1e-8, "m", 2), (1, 2, "/a", "x", 2.0, "m", 9), (1, 3, "/a", "y", 1.0, "m", 1), (1, 4, "/a", "y", 1.0, "m", 1)]
    rows += [(2, 0, "/a", "x", None, "m", 1), (2, 1, "/b", "x", None, "m", 1), (2, 2, "/a", None, 1.0, "m", 1), (2, 3, "/b", None, 1.0, "m", 1), (3, 0, "/a", "x", 5.0, "m", 1), (3, 1, "/b", "x", 5.0, "m", 1), (3, 2, None, "x", 5.0, "m", 0)]
    made = K.cross_parent_duplicates(spark.createDataFrame(rows, "id long, position int, array string, label string, value double, unit string, score int"))
    assert "Join" not in plan(made)
    assert sorted(map(tuple, made.collect()), key=str) == [(1, 0, "/a", 1), (3, 1, "/b", 0), (3, 2, None, 0)]


def test_path_coverage_joins_nothing_by_id(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        leaves = spark.createDataFrame([(1, "/a/b", '"x"'), (1, "/a/c", "1"), (2, "/a/b", "null"), (3, "/ab", "2"), (4, "", "5"), (5, "/a/b", None)], "id long, pointer string, value string")
        required = spark.createDataFrame([("r", ["/a/-", "/z"]), ("s", ["/ab"]), ("t", [""])], "requirement_id string, target_paths array<string>")
        made = L.path_coverage(required, leaves, 3)
        assert plan(made).count("SortMergeJoin") <= 2  # paths with targets, once for hits and once for marks
        assert {tuple(r) for r in made.collect() if r[2]} == {(1, "r", True), (1, "t", True), (3, "s", True), (3, "t", True), (4, "t", True)}
        assert made.count() == 15 and made.distinct().count() == 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ledgers_parse_documents_once(spark):
    for name in ("field_ledger", "requirement_coverage"):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()


import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonpointer as J
from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import documents as D
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import lines as L
from tessera.operators import ranking, reports
from tessera.operators import search as S
from tessera.sources import archives, tables
from tessera.streaming import sessions


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "c string").select(*columns).first()


def grade(spark, text, **config):
    return L.grade(spark.createDataFrame([(text,)], "line string"), config=T.QualityConfig(**config)).first().quality


def test_line_quality(spark):
    assert grade(spark, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11")[:] == ("drop", 0.05, "numeric_array")
    q = grade(spark, "##.DELAY= (6.5, 6.5)")
    assert q.kind == "keep" and "structured_text" in q.reason and "too_many_symbols" in q.reason
    assert grade(spark, "##.DELAY= (6.5, 6.5)", keep_score=0.9).kind == "drop"
    assert grade(spark, "Run Time                                     8 min").kind == "keep"
    assert grade(spark, "-" * 40).reason == "repeated_char_noise"
    assert "structured_text" in grade(spark, "##$BF1= 400.13").reason
    q = grade(spark, "SFO1= 500.133088507478")
    assert q.kind == "keep" and q.score == 0.55
    assert grade(spark, None).reason == "empty" and grade(spark, " x ").reason == "too_short" and grade(spark, "ab\x00\x01").reason == "many_control_chars"


def test_protected_lines(spark):
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(["This is a fine line of text", "-" * 30, "x"])], "doc_id string, line_no long, line string")
    marked = L.protect(lines, spark.createDataFrame([("d", 1), ("d", 1), ("d", 99)], "doc_id string, line_no long"))
    assert sorted(r.line_no for r in L.quality_filter(marked, protected=F.col("is_protected")).collect()) == [0, 1]


def test_noisy_payload(spark):
    row = "1A2b3C4d5E" * 7
    assert one(spark, "\n".join([row] * 3), T.is_noisy_payload("c"))[0]
    assert not one(spark, "\n".join([row] * 2), T.is_noisy_payload("c"))[0]
    assert not one(spark, "some text\n" * 40 + row, T.is_noisy_payload("c"))[0]
    assert one(spark, "##XYDATA\n" + "\n".join([row] * 2), T.is_noisy_payload("c"))[0]


def test_scalar_functions(spark):
    got = one(spark, "Scan from 5.5 to -2 MHz on 2024-03-01", T.range_bounds("c"), T.first_number("c"), T.infer_unit("c"), T.first_date("c"), T.slug("c", 12), T.index_token("c"))
    assert got[0][:] == (-2.0, 5.5) and got[1:] == (5.5, "MHz", "2024-03-01", "scan-from-5-", "scan_from_5_5_to_2_mhz_on_2024_03_01")
    assert one(spark, 'a+b "c"/d', T.escape_query("c"))[0] == 'a\\+b \\"c\\"\\/d'
    assert one(spark, "no sample here; sample", T.negated("c", "sample"))[0] and not one(spark, "a sample", T.negated("c", "sample"))[0]
    assert one(spark, "a\nb\nc\nd\ne", T.context_lines("c", F.lit("c"), 1))[0] == "b\nc\nd"
    assert one(spark, "a\r\n\tb  c \n", T.normalise_chunk("c"))[0] == "a\n b c"
    assert one(spark, "x" * 41, T.estimated_tokens("c"), F.length(T.truncate_tokens("c", 10)))[:] == (11, 40)
    assert one(spark, "a/b.PNG", T.file_extension("c"), T.file_type(T.file_extension("c")))[:] == ("png", "image")
    assert [tuple(x) for x in one(spark, "# t\nAA = 1\n bb: two\n", T.key_values("c"))[0]] == [("AA", "1"), ("bb", "two")]


CASE = [("left " * 6, 0), ("tiny", 1), ("right " * 6, 2)]


@pytest.mark.parametrize("known, want", [({0: 0.9, 1: 0.1}, [[0], [1, 2]]), ({}, [[0, 1], [2]])])
def test_small_chunks_merge_to_the_nearer_side(known, want):
    sizes = {i: len(t.split()) for t, i in CASE}
    got = C.merge_small(C.split_at_gaps([[0], [1], [2]], 32), sizes, 5, 20, known)
    assert [p.lines for p in got] == want and max(p.sources for p in got) == 2 and any("min_token_merge" in p.operations for p in got)


def test_gap_barriers_and_budget():
    assert [p.lines for p in C.merge_small(C.split_at_gaps([[0, 40]], 32), {0: 1, 40: 1}, 5, 20, {})] == [[0], [40]]
    assert [p.lines for p in C.merge_small(C.split_at_gaps([[0], [1]], 32), {0: 4, 1: 4}, 5, 6, {0: 0.0})] == [[0], [1]]
    assert C.semantic_groups([3, 6], 10) == [(0, 3), (3, 9)] and C.semantic_groups([4], 9) == [(0, 8)] and C.semantic_groups([], 3) == [(0, 2)]


def test_packing(spark):
    lines = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([30, 30, 200, 3, 3])], "doc_id string, line_no long, line string")
    got = sorted((r.chunk_no, r.start, r.end) for r in C.pack(lines, 16).collect())
    assert got == [(0, 0, 1), (1, 2, 2), (2, 3, 4)]
    merged = C.post_process(C.pack(lines, 16), lines, 4, 100, 32).orderBy("chunk_no").collect()
    assert [(r.start, r.end) for r in merged] == [(0, 1), (2, 4)] and merged[1].source_chunk_count == 2


def test_fusion(spark):
    kind = "id string, score double, rank int"
    v, f = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 2)], kind), spark.createDataFrame([("b", 3.0, 1), ("c", 2.0, 2)], kind)
    assert [r.id for r in S.rrf(v, f, 2, 1, 3, 1).collect()] == ["b", "c"]


NT = """<http://e/A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/T> .
<http://e/A> <http://e/label> "Al\\"pha"@en .
<http://e/A> <http://e/label> "Alfa"@fr .
<http://e/A> <http://e/broader> <http://e/B> .
_:b0 <http://e/label> "anon" .
# a comment
<http://e/B> <http://e/label> "Beta"^^<http://e/string> .
"""


def test_rdf(spark):
    triples = G.english_or_untagged(G.skolemise(G.parse_ntriples(spark.createDataFrame([(x,) for x in NT.splitlines()], "value string"))))
    rows = triples.collect()
    assert len(rows) == 5 and {r.o for r in rows if r.o_kind == "literal"} == {'Al"pha', "anon", "Beta"}
    nodes, edges = G.to_nodes(triples), G.to_edges(triples)
    kept, left = G.remove_untyped(nodes, edges)
    assert [r.uri for r in kept.collect()] == ["http://e/A"] and left.count() == 0
    assert [tuple(r) for r in G.related_terms(edges, nodes, "http://e/label").collect()] == [("http://e/A", "broader", "Beta")]
    assert G.type_profile(nodes, edges).first()[:] == ("http://e/T", 1, ["http://e/label"], ["http://e/broader"])
    turtle = G.to_turtle(triples, spark.createDataFrame([("http://e/B",)], "s string")).first().turtle
    assert turtle == '<http://e/B> <http://e/label> "Beta"^^<http://e/string> .'
    found = G.candidate_records(nodes, ["http://e/label"], ["http://e/definition"], ["http://e/label"]).collect()
    assert {r.title for r in found} == {'Al"pha', "Beta"}


def test_expansion(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "q", "d")], "s string, p string, o string")
    seeds = spark.createDataFrame([("a",)], "u string")
    run = lambda *a, **k: sorted(tuple(r)[1:] for r in G.expand(e, seeds, *a, **k).collect())
    assert run(0) == [] and run(1) == [("a", "p", "b")] and run(2) == [("a", "p", "b"), ("b", "p", "c")]
    assert len(run(9)) == 4 and run(9, predicates=["p"]) == [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")]
    assert run(1, "in") == [("c", "p", "a")] and len(run(1, "both")) == 2 and len(run(3, limit=2)) == 2


def test_evidence(spark):
    names = list(E.DEFAULT_ASSESSMENT)
    values = lambda **k: tuple(k.get(n, "low" if n in ("environment_dependence", "uncertainty") else "yes") for n in names)
    a = spark.createDataFrame([("x", 0, *values(groundedness="no")), ("x", 1, *values()), ("y", 0, *values(groundedness="no")), ("z", 0, *values(uncertainty="high"))], "candidate_id string, position int, " + ", ".join(f"{n} string" for n in names))
    got = {r.candidate_id: r.route for r in E.route_candidates(spark.createDataFrame([(c,) for c in "xyzw"], "candidate_id string"), a).collect()}
    assert got == {"x": "portable_evidence", "y": "rejected_evidence", "z": "contextual_evidence", "w": "contextual_evidence"}
    rows = spark.createDataFrame([("The  quick brown fox", "see the quick brown fox run"), ("quick brawn foxes", "the quick brown foxes"), ("tiny", "none"), (None, "x")], "e string, c string")
    assert [r.supported for r in E.validate(rows, "e", "c").collect()] == [True, True, False, False]
    d = spark.createDataFrame([(1, "f", "same", 2, "a"), (2, "f", "same", 1, "a"), (3, "f", "same", 1, "longer"), (4, "g", "same", 1, "a"), (5, "f", "", 1, "a"), (6, "f", "", 1, "a")], "id long, f string, t string, r int, claim string")
    kept = E.dedup_exact(d, [F.col("f"), F.col("t")], "id", F.col("r"), F.col("claim"), F.col("id")).filter("kept").collect()
    assert sorted(r.id for r in kept) == [3, 4, 5, 6]
    assert E.match_score("abc", "zzz") == 0 and E.match_score("", "x") == 0


def test_windows_and_components(spark):
    spans = [(1, 0, 10), (2, 5, 7), (3, 100, 400), (4, 390, 500), (5, 503, 900), (6, 2000, 2001)]
    df = spark.createDataFrame([("k", *s) for s in spans], "k string, id long, s long, e long")
    near = 5
    want = {(a[0], b[0]) for a in spans for b in spans if a[0] != b[0] and ((a[1] <= b[2] and b[1] <= a[2]) or abs(a[1] - b[1]) <= near or abs(a[2] - b[2]) <= near)}
    assert {tuple(r) for r in E.window_neighbours(df, "k", "id", "s", "e", near).collect()} == want
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.component for r in E.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[90] == 90


def test_json():
    doc = {"a": [{"b": 1}, {"b": 2}, {"b": 3}], "e": {}, "z~/": 0}
    assert J.get(doc, "/a/1/b") == 2 and J.get(doc, "/z~0~1") == 0 and J.get(doc, "/a/9", "no") == "no" and J.exists(doc, "/e")
    made, changed = J.apply_writes(doc, [{"op": "remove", "path": "/a/0"}, {"op": "remove", "path": "/a/2"}, {"op": "append", "path": "/n/-", "value": 5}, {"op": "replace", "path": "/e/x/y", "value": 1}])
    assert made["a"] == [{"b": 2}] and made["n"] == [5] and made["e"] == {"x": {"y": 1}} and len(changed) == 4 and doc["a"][0] == {"b": 1}
    assert J.apply_writes(doc, [{"op": "merge", "path": "/a", "survivor": 0, "merged": [0, 2]}])[0]["a"] == [{"b": 1}, {"b": 2}]
    for bad in ({"op": "remove", "path": "/q"}, {"op": "remove", "path": "/a/9"}):
        with pytest.raises(KeyError):
            J.apply_writes(doc, [bad])
    assert list(J.leaves(doc))[-2:] == [("/e", "object", "{}"), ("/z~0~1", "number", "0")]
    assert J.without_missing({"a": None, "b": [None, 0], "c": {"d": ""}, "f": False}) == {"b": [0], "f": False}
    assert J.deep_merge({"a": 1, "b": [1]}, {"a": 2, "b": [1, 2], "c": 3}) == {"a": 1, "b": [1, 2], "c": 3}
    assert J.fill_ids([{"t": 1}])[0]["id"].startswith("obj-") and J.dotted_to_pointer("$.a[0].b") == "/a/0/b"


SCHEMA = {"$defs": {"P": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}, "next": {"$ref": "#/$defs/P"}}}}, "type": "object", "properties": {"p": {"anyOf": [{"$ref": "#/$defs/P"}, {"type": "null"}]}, "t": {"type": ["string", "null"], "enum": ["x", None]}}, "additionalProperties": False}


def test_schemas():
    assert J.validate({"p": {"n": 1, "next": {"n": 2}}, "t": None}, SCHEMA) == []
    assert [p for p, _ in J.validate({"p": {"n": -1, "next": {}}, "t": "y", "u": 1}, SCHEMA)] == ["/p/n", "/p/next", "/t", "/u"]
    assert J.schema_at(SCHEMA, "/p/next/n")["type"] == "integer" and J.schema_at(SCHEMA, "/p/zz") is None
    assert J.reachable_defs(SCHEMA, SCHEMA["properties"]["p"]) == ["P"] and J.coverage(SCHEMA, {"p": {"n": 0}}) == (1, 3)
    assert J.required_paths(SCHEMA["$defs"]["P"]) == ["/n"] and J.default_value({"$ref": "#/$defs/P"}, SCHEMA) == {}


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}'), (2, "oops"), (3, None)], "id long, doc string")
    assert {tuple(r) for r in D.leaf_paths(df, "id", "doc").collect()} == {(1, "/a/0", "number", "1"), (1, "/a/1/b", "string", '"x"'), (2, "", "invalid", "oops")}
    bad = spark.createDataFrame([('{"a": 1}', '[{"op": "remove", "path": "/b"}]')], "d string, w string").select(D.apply_writes(F.col("d"), F.col("w")).alias("r")).first().r
    assert bad.document == '{"a": 1}' and bad.error
    at = spark.createDataFrame([(1, k, "w", v) for k, v in enumerate([1.0, 1.0 + 1e-8, 2.0, 1.0])], "p long, o long, label string, value double")
    assert [r.group for r in D.group_attributes(at, "p", "o", "label", "value").orderBy("o").collect()] == [0, 0, 1, 0]


def test_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "hi")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/t.csv", "a,b\n1,2\n3,4\n5,6\nx,y\n")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("noext", b"\xff\xfe")
    (tmp_path / "p.zip").write_bytes(outer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    members = archives.read_archives(archives.read_files(spark, str(tmp_path), "*.zip"))
    got = {r.file_path: r for r in archives.with_text(members).collect() if r.error is None}
    assert set(got) == {"d/t.csv", "in.zip/deep.txt", "noext"} and got["in.zip/deep.txt"].text == "hi"
    assert got["d/t.csv"].text == "Sheet1/1: t\n\na,b\n1,2\n5,6\nx,y\n" and members.filter("error is not null").count() == 1
    assert archives.packages(members).first().n_files == 3 and len(archives.packages(members).first().data_package_id) == 8
    assert {r.file_type for r in archives.inventory(members).filter("error is null").collect()} == {"table", "plain_text"}
    with pytest.raises(ValueError):
        archives.point_lookup(members, "nope")


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "m1", 1), ("b", "m2", 2)], "stage string, model string, x int")
    tables.save(df, path, ["stage"])
    tables.save(df.filter("stage = 'a'").withColumn("x", F.lit(9)), path, ["stage"], "overwrite")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 9] and tables.load(spark, path, stage="b").first().x == 2
    assert tables.clear(spark, path, "stage=a") and not tables.clear(spark, path, "stage=a") and spark.read.parquet(path).count() == 1
    log = str(tmp_path / "log")
    for _ in range(2):
        tables.append_numbered(spark, spark.createDataFrame([("p", "q"), ("p", "r")], "op string, text string"), log, "op")
    assert sorted(r.sequence for r in spark.read.parquet(log).collect()) == [1, 2, 3, 4]
    assert sorted(r.x for r in tables.upsert(df, df.filter("stage = 'b'").withColumn("x", F.lit(7)), ["stage"]).collect()) == [1, 7]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, True), ("a", 5.0, 1.0, True), ("b", 1.0, 1.0, False)], "k string, q double, w double, ok boolean")
    assert {r.k: r.score for r in reports.weighted_score(df, ["k"], F.col("q"), F.col("w"), F.col("ok")).collect()} == {"a": 1.0, "b": 0.0}
    ranked = ranking.rank_files(spark.createDataFrame([("b/readme.md", 1), ("a/readme.md", 1), ("x.png", 1)], "p string, s long"), "p", "s", "p").orderBy("rank").collect()
    assert [(r.p, r.score) for r in ranked] == [("a/readme.md", 0.85), ("b/readme.md", 0.85), ("x.png", 0.0)]


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    rows.write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("id long, t string").parquet(source)
        sessions.resume(stream, lambda d: d.withColumn("n", F.length("t")), ["id"], target, str(tmp_path / "cp")).awaitTermination()
        rows.union(spark.createDataFrame([(3, "c")], "id long, t string")).write.mode("append").parquet(source)
    sessions.resume(spark.readStream.schema("id long, t string").parquet(source), lambda d: d.withColumn("n", F.length("t")), ["id"], target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    e = spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 1 as u union all select timestamp'2024-01-01 10:00:00', 1 union all select timestamp'2024-01-05 00:00:00', 1")
    assert sorted(r.n for r in sessions.session_counts(e, "ts", "u").collect()) == [1, 2]


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert json.dumps(sorted(__spark_entry__.queries()))


def test_overview_rules(spark):
    from tessera.operators import overview as O

    rows = [(1, "Acquisition settings"), (2, "no calibration was ever given for this run; further down stand parameter values"), (3, ""), (4, "raw data")]
    got: dict = {}
    for r in O.assign_groups(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect():
        got.setdefault(r.id, set()).add(r.group)
    assert got == {1: {"acquisition_settings", "instrument_settings"}, 2: {"parameter_settings"}, 4: {"raw_data"}}
    types = spark.createDataFrame([("qudt__Unit",), ("qudt__Thing",), ("ex__Thing",), ("swrl__x",)], "t string")
    assert [r[0] for r in types.select(O.indexable_type(F.col("t"))).collect()] == [True, False, True, False]
    e = [("1", "a", "uses", "b", ["in the log"]), ("2", "a", "uses", "b", ["in the log"]), ("3", "a", "uses", "z", ["x y z"]), ("4", "a", "uses", "a", ["x y z"]), ("5", "a", "contains", "b", ["x y z"]), ("6", "b", "uses", "a", ["n/a"]), ("7", "b", "seeded", "a", ["x y z"])]
    edges = spark.createDataFrame(e, "edge_id string, source string, relation string, target string, evidence array<string>")
    seeds = spark.createDataFrame([("b", "seeded", "a")], "source string, relation string, target string")
    why = {r.edge_id: r.drop_reason for r in O.sanitise_edges(edges, spark.createDataFrame([("a",), ("b",)], "node_id string"), seeds).collect()}
    assert why == {"1": None, "2": "repeated", "3": "dangling", "4": "self_loop", "5": "containment", "6": "weak_evidence", "7": "repeated"}
    role = spark.createDataFrame([("/was_generated_by/0", "x"), ("/x/carried_out_by/1", "Bruker GmbH"), ("/x/had_input_entity/0", "JCAMP file")], "p string, w string")
    assert [r[0] for r in role.select(O.parent_role(F.col("p"), F.col("w"), F.lit("C"))).collect()] == ["activity", "manufacturer", "parameter_file"]


def test_ledgers(spark):
    from tessera.operators import ledgers as L

    df = spark.createDataFrame([(1, "shift", "from 0 to 10 ppm"), (2, "n", "5")], "id long, title string, value string")
    assert sorted(tuple(r) for r in L.decompose_ranges(df, "title", "value").collect()) == [(1, "shift maximum", "10.0"), (1, "shift minimum", "0.0"), (2, "n", "5")]
    leaves = spark.createDataFrame([(1, "/a/0/title", "string", '"Outer"'), (1, "/a/0/b/x", "number", "1"), (1, "/a/0/b/label", "string", '"Inner"')], "id long, pointer string, type string, value string")
    got = {r.pointer: r.context for r in L.ancestor_labels(leaves).collect()}
    assert got["/a/0/b/x"] == "Outer > Inner" and got["/a/0/title"] == "Outer"
    old = spark.createDataFrame([("q", ["a", "b"], ["a"])], "query_id string, result_ids array<string>, selected_ids array<string>")
    new = spark.createDataFrame([("q", ["a", "c"], ["c"])], old.schema)
    assert L.query_ledger(old, new).first().rejected_ids == ["a"]
    b = spark.createDataFrame([(1, "sample solvent"), (2, "solvent sample temperature")], "branch_id long, text string")
    q = spark.createDataFrame([("q", "the sample temperature and solvent")], "query_id string, text string")
    assert [(r.branch_id, r.score) for r in L.score_branches(b, q).orderBy("position").collect()] == [(2, 3), (1, 2)]


def test_ancestor_labels_broadcast_no_leaves(spark):
    from tessera.operators import ledgers as L

    docs = spark.range(300).selectExpr("id", """concat('{"title": "T', id, '", "a": {"label": "L", "x": [1, {"name": "N"}]}, "b~/c": null}') AS doc""")
    found = L.ancestor_labels(D.leaf_paths(docs, "id", "doc").union(D.leaf_paths(docs.filter("id = 1"), "id", "doc")))
    got = {(r.id, r.pointer): r.context for r in found.collect()}
    assert len(got) == found.count() == 300 * 5
    assert got[1, "/a/x/1/name"] == "T1 > L > N" and got[2, "/a/x/0"] == "T2 > L" and got[3, "/b~0~1c"] == "T3"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") <= 4  # the leaves are made once in the initial and in the final plan


def test_candidates_of_repeated_results(spark):
    from tessera.operators import selection as S

    asked = spark.createDataFrame([("/a", ["q1", "q0"]), ("/b", ["q0", "q9"]), ("/c", [])], "pointer string, query_ids array<string>")
    results = spark.range(40_000).selectExpr("concat('q', id % 2) AS query_id", "id AS position", "concat('u', (id * 7) % 10) AS uri")
    found = S.joined_candidates(asked, results)
    got = {(r.pointer, r.uri): r.place for r in found.collect()}
    assert got == {("/a", u): k for k, u in enumerate(["u7", "u1", "u5", "u9", "u3", "u0", "u4", "u8", "u2", "u6"], 1)} | {("/b", u): k for k, u in enumerate(["u0", "u4", "u8", "u2", "u6"], 1)}
    assert S.joined_candidates(asked, results.limit(0)).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(position" not in plan and plan.count("shiftleft")  # repeated results are reduced before the join


def test_resources_are_numbered_over_all_tasks(spark):
    from tessera.operators import graph as G

    members = spark.range(5000).selectExpr("if(id < 4990, 'big', 'small') AS identifier", "concat('u', 10000 + (id * 37) % 5000) AS uri")
    made = G.resources_of(members.union(members))
    got = [tuple(r) for r in made.orderBy("identifier", "position").collect()]
    want = sorted({tuple(r) for r in members.collect()})
    assert [(i, u) for i, _, u in got] == want and [p for _, p, _ in got] == [*range(1, 4991), *range(1, 11)]
    assert "windowspecdefinition(identifier" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_chunk_documents(spark):
    text = "\n".join(f"the {w} line number {k} speaks of {w}" for k, w in enumerate(["cats"] * 6 + ["ships"] * 6 + ["stones"] * 6))
    docs = spark.createDataFrame([("d", text + "\n" + "-" * 40), ("e", "one short line of text"), ("f", None)], "doc_id string, text string")
    for strategy, more in (("fixed", {}), ("semantic", {"min_lines": 5, "percentile": 90})):
        got = C.chunk_documents(docs, strategy, budget=60, least=5, **more).orderBy("doc_id", "chunk_no").collect()
        assert {r.doc_id for r in got} == {"d", "e"} and all(r.tokens <= 60 for r in got) and max(r.end for r in got) == 17
    assert C.chunk_documents(docs, protected=spark.createDataFrame([("d", 18)], "doc_id string, line_no long")).agg(F.max("end")).first()[0] == 18


def test_placement(spark):
    from tessera.operators import placement as P

    parents = spark.createDataFrame([("d", "/p0", "software", "TopSpin", "TopSpin software"), ("d", "/p1", "manufacturer", "Bruker", "Bruker GmbH"), ("e", "/p2", "solvent", "CDCl3", "solvent")], "doc string, parent string, role string, title string, words string")
    evidence = spark.createDataFrame([("d", "c1", "software_signal", "TopSpin version 3.5"), ("d", "c2", "other", "made by Bruker"), ("d", "c3", "other", "Bruker frequency"), ("e", "c4", "other", "the weather")], "doc string, candidate_id string, category string, text string")
    assert {(r.parent, r.candidate_id): r.score for r in P.score_parents(parents, evidence).collect()} == {("/p0", "c1"): 12, ("/p1", "c2"): 7}
    notes = spark.createDataFrame([(k, f"temp_{k}", "other", "f", "title of it") for k in range(8)] + [(9, "7", "measurement_signal", "f", "x")], "o long, note_id string, category string, file_path string, text string")
    groups = P.projection_groups(notes, "o").collect()
    assert sorted(len(g.note_ids) for g in groups) == [2, 6] and all(g.path == "/title" and g.group_id.startswith("group:title:") for g in groups)
    b = spark.createDataFrame([(["device"], "carried_out_by", "AgenticEntity", 1, True, 2), (["parameter_setting"], "title", "x", 1, False, 0)], "h array<string>, s string, r string, d int, ok boolean, n int")
    assert [r[0] for r in b.select(P.branch_points(*(F.col(c) for c in ("h", "s", "r", "d", "ok", "n")))).collect()] == [64, -70]

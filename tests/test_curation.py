"""Curation, selection, files and recovery on small inputs."""

import io
import random
import re
import zipfile
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import drafts as P
from tessera.functions import jsonpointer as J
from tessera.operators import chunking as C
from tessera.operators import curation as K
from tessera.operators import documents as D
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import selection as S
from tessera.sources import archives, office, tables
from tessera.sources import vocabularies as V
from tessera.streaming import recovery

SCHEMA = {"properties": {"terms": {"type": "array", "items": {"$ref": "#/$defs/Term"}}, "unit": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/Term"}]}, "note": {"type": "string"}}, "$defs": {"Term": {"title": "DefinedTerm", "type": "object"}}}


def test_clear_stays_below_its_table(spark, tmp_path):
    for name in ("t", "sibling"):
        spark.range(3).withColumn("stage", F.lit("a")).write.partitionBy("stage").parquet(str(tmp_path / name))
    root = str(tmp_path / "t")
    for bad in (("..",), (".",), ("",), ("stage=..", ".."), ("=x",), ("a", "..", "..", "sibling")):
        with pytest.raises(ValueError):
            tables.clear(spark, root, *bad)
    assert not tables.clear(spark, root, "stage=../../sibling") and not tables.clear(spark, root, "../sibling") and not tables.clear(spark, root, "..\\sibling")
    assert tables.safe_part("stage=../x") == "stage=.._x"
    assert spark.read.parquet(str(tmp_path / "sibling")).count() == 3
    assert tables.clear(spark, root, "stage=a") and not tables.clear(spark, root, "stage=a") and tables.clear(spark, root)
    assert spark.read.parquet(str(tmp_path / "sibling")).count() == 3


def test_numbering_goes_on_and_other_errors_are_raised(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(o, n) for o, n in x], "operation string, note string")
    path = str(tmp_path / "log")
    tables.append_numbered(spark, rows(("a", "x"), ("a", "y"), ("b", "z")), path, "operation")
    tables.append_numbered(spark, rows(("a", "w")), path, "operation")
    assert sorted((r.operation, r.sequence) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    (tmp_path / "other").mkdir()
    spark.range(2).write.parquet(str(tmp_path / "other" / "t"))
    with pytest.raises(Exception, match="sequence|operation"):
        tables.append_numbered(spark, rows(("a", "x")), str(tmp_path / "other" / "t"), "operation")


def test_texts_that_are_not_json(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"a": ""}',)], "d string")
    got = df.select(D.get_pointer(F.col("d"), F.lit("/a")).alias("p"), D.clean(F.col("d")).alias("c"), D.validation_issues(F.col("d"), {"type": "object"}).alias("v"), D.changed(F.col("d"), lambda x: x).alias("x")).collect()
    assert [tuple(r[:2]) for r in got] == [(None, None), (None, None), ('""', "{}")]
    assert [[i.message for i in r.v] for r in got] == [["not JSON"], [], []] and got[0].x is None


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_at_any_depth():
    data = _zip([("leaf.txt", b"x")])
    for k in range(40):
        data = _zip([(f"{k}.zip", data)])
    found = list(archives.zip_members(data))
    assert len(found) == 1 and found[0][0].endswith("/0.zip/leaf.txt") and found[0][0].count("/") == 40 and found[0][1:] == (b"x", None)
    assert archives.archive_stem("A.b.ZIP") == "A.b"
    for bad in ("x.tar", ".zip", ""):
        with pytest.raises(ValueError):
            archives.archive_stem(bad)


def test_files_that_are_not_what_they_say():
    for name in ("a.xlsx", "a.ods", "a.pdf", "a.xls"):
        with pytest.raises(ValueError):
            archives.text_of(b"nothing of the kind", name)
    assert office.pdf_text(b"%PDF-1.4\ntrailer") == "" and archives.text_of(None, "x.pdf") is None


def test_characters_of_mapped_fonts():
    page = b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>"
    shown = b"BT /F1 9 Tf [<00010002> -300 <0003>] TJ T* (ignored) Tj ET"
    table = b"2 beginbfchar <0001> <0048> <0002> <0069> endbfchar 1 beginbfrange <0003> <0300> <0041> endbfrange"
    stream = lambda b: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(b), b)
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", page, stream(shown), b"<< /Type /Font /ToUnicode 6 0 R >>", stream(table)]
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in enumerate(bodies, 1))
    assert office.pdf_text(data).split("\n")[0] == "Hi A"


def test_turtle():
    text = """@prefix e: <http://e.org/> . @base <http://b.org/d/> .
    e:a a e:C ; e:v 1, -2.5, 3e4, true , 'x'^^e:t, "é\\u00e9"@de-AT ; e:l ( <x> "q" ) ; e:n [ e:k [] ; ] ; . # end
    PREFIX f: <http://f.org/#>
    f:x.y e:p '''long 'quoted'
text''' . [ e:q e:r ] . () e:p _:b.1 ."""
    got = V.Turtle(text).read()
    plain = {t[1:] for t in got}
    assert ("http://e.org/v", "-2.5", "literal", None, V.XSD + "decimal") in plain and ("http://e.org/v", "éé", "literal", "de-AT", None) in plain
    assert ("http://f.org/#x.y", "http://e.org/p", "long 'quoted'\ntext", "literal", None, None) in got
    assert (V.RDF + "nil", "http://e.org/p", "_:b.1", "bnode", None, None) in got
    assert sum(t[1] == V.RDF + "first" for t in got) == 2 and ("http://e.org/a", V.RDF + "type", "http://e.org/C", "iri", None, None) in got
    assert any(t[1] == V.RDF + "first" and t[2] == "http://b.org/d/x" for t in got)
    for bad in ("<a> <b>", "<a> <b> <c>", "x:a x:b x:c .", "<a> <b> 'open .", "<a> ; .", "[ <p> <o>", "<a> <p> ( <b> ."):
        with pytest.raises(ValueError):
            V.Turtle(bad).read()


def test_rdf_xml():
    text = f"""<r:RDF xmlns:r="{V.RDF}" xmlns:e="http://e/" xml:lang="en"><e:C r:about="http://x" e:k="v"><e:p>hi</e:p><e:n r:datatype="http://t">1</e:n>
    <e:q r:resource="http://y"/><e:d r:parseType="Resource"><e:z>in</e:z></e:d><e:b r:nodeID="n"/></e:C></r:RDF>"""
    got = V.read_rdf_xml(text)
    assert ("http://x", V.RDF + "type", "http://e/C", "iri", None, None) in got and ("http://x", "http://e/k", "v", "literal", "en", None) in got
    assert ("http://x", "http://e/p", "hi", "literal", "en", None) in got and ("http://x", "http://e/n", "1", "literal", None, "http://t") in got
    assert ("http://x", "http://e/b", "_:n", "bnode", None, None) in got and any(t[1] == "http://e/z" and t[0].startswith("_:") for t in got)
    with pytest.raises(ValueError):
        V.triples_of("<open>", "a.rdf")


def test_addresses(spark):
    pages = ["https://github.com/o/r/blob/main/a/b.yaml", "http://GitHub.com/o/r/raw/v1/x.json?y=1", "https://github.com/o/r/tree/main/a", "https://github.com/o/r/blob/main", "https://e.org/o/r/blob/main/a", "ftp://github.com/o/r/blob/m/a"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "u string").select(V.raw_address_column(F.col("u"))).collect()]
    assert got == [V.raw_address(p) for p in pages] and got[0] == "https://raw.githubusercontent.com/o/r/main/a/b.yaml"


def test_json_patch():
    doc = {"a": [1, 2], "b": {"c~/": True}}
    assert P.apply_patch(doc, [{"op": "add", "path": "/a/1", "value": 9}, {"op": "move", "from": "/a/0", "path": "/d"}, {"op": "copy", "from": "/b", "path": "/e"}, {"op": "remove", "path": "/b/c~0~1"}]) == {"a": [9, 2], "b": {}, "d": 1, "e": {"c~/": True}}
    assert P.apply_patch(doc, [{"op": "replace", "path": "", "value": 3}]) == 3 and P.apply_patch(doc, [{"op": "test", "path": "/a", "value": [1, 2]}]) == doc
    bad = [
        {"op": "remove", "path": "/x"}, {"op": "replace", "path": "/x", "value": 1}, {"op": "add", "path": "/a/3", "value": 1}, {"op": "add", "path": "/a/01", "value": 1}, {"op": "test", "path": "/a/0", "value": True},
        {"op": "add", "path": "/a/0"}, {"op": "move", "path": "/a"}, {"op": "move", "from": "/b", "path": "/b/x"}, {"op": "what", "path": "/a"}, {"op": "add", "path": "/x/y", "value": 1},
    ]
    for o in bad:
        with pytest.raises((ValueError, KeyError)):
            P.apply_patch(doc, [o])
    assert doc == {"a": [1, 2], "b": {"c~/": True}}


def test_shapes_terms_and_actions():
    assert P.coerce({"a": "x", "b": ["y"], "c": None, "d": 1}, {"a": [" p ", "", "q"], "b": 5, "c": "no", "e": 1}) == {"a": "p; q", "b": ["5"], "c": None, "d": 1}
    assert P.term_value(SCHEMA["properties"]["unit"], SCHEMA, "u", "T", None) == {"id": "u", "title": "T"} and P.term_value(SCHEMA["properties"]["note"], SCHEMA, "u", "T", "v") == "u"
    once = P.term_value(SCHEMA["properties"]["terms"], SCHEMA, "u", None, "v", [{"id": "o"}])
    assert once == [{"id": "o"}, {"id": "u", "from_CV": "v"}] == P.term_value(SCHEMA["properties"]["terms"], SCHEMA, "u", None, "v", once)
    writes = [{"target_path": "/a/0", "mode": "remove"}, {"target_path": "/a/2", "mode": "remove"}, {"target_path": "/b/-", "mode": "append", "items": [1, 2]}, {"target_path": "/a", "mode": "merge", "survivor_index": 1, "merged_indices": [5]}]
    assert [(w["target_path"], len(w.get("items", []))) for w in P.sorted_actions(writes)] == [("/a", 0), ("/a/2", 0), ("/a/0", 0), ("/b/-", 1), ("/b/-", 1)]
    assert P.prune_scaffold({"x": [{"k": 1}], "y": 2, "z": 3}, [{"path": "/x/0", "value": {"k": 1}, "prune_if_unchanged": True}, {"path": "/y", "value": 2, "prune_if_unchanged": False}, {"path": "/z", "value": 4, "prune_if_unchanged": True}]) == {"y": 2, "z": 3}
    assert J.validate(P.shell(SCHEMA), {"type": "object"}) == []


@pytest.mark.parametrize("exact", [0.5, 0.8])
def test_fuzzy_links_against_brute_force(spark, exact, monkeypatch):
    monkeypatch.setattr(E, "CELL", 7)
    draw = random.Random(3)
    texts = ["temp = 298 k", "te = 298.15", "td = 65536", "td = 65537", "td = 65536", "short"]
    texts += ["".join(draw.choice("abc =12") for _ in range(draw.randint(10, 40))) for _ in range(60)]
    rows = [(k, t, "x" if k % 3 else "y") for k, t in enumerate(texts)]
    got = {(r.a, r.b): r.similarity for r in E.fuzzy_links(spark.createDataFrame(rows, "id long, t string, c string"), "id", "t", "c", exact).collect()}
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    first = {}
    for k, t, c in rows:
        first.setdefault((norm(t), c), k)
    want = {(first[norm(t), c], k): 1.0 for k, t, c in rows if first[norm(t), c] < k and len(norm(t)) >= 10}
    nodes = [(k, t, c) for (t, c), k in first.items() if len(t) >= 10]
    for (i, t, c), (j, u, d) in combinations(sorted(nodes), 2):
        ratio = round(SequenceMatcher(None, t, u).ratio(), 6)
        if c != d and ratio >= exact:
            want[i, j] = ratio
    assert got == want
    groups = {r.node: (r.component, r.size, r.similarity) for r in E.fuzzy_groups(spark.createDataFrame([(a, b, v) for (a, b), v in got.items()], "a long, b long, similarity double")).collect()}
    head = {k: k for pair in want for k in pair}
    for _ in head:
        for a, b in want:
            head[a] = head[b] = min(head[a], head[b])
    best = {}
    for (a, _), v in want.items():
        best[head[a]] = max(best.get(head[a], 0), v)
    assert groups == {k: (h, sum(x == h for x in head.values()), best[h]) for k, h in head.items()}
    assert len(got) > 1


def test_passages_that_begin_or_end_inside_a_word(spark):
    docs = spark.createDataFrame([(1, "the unbelievable story of measured results is here"), (2, "nothing of it"), (3, "a-b c"), (4, None)], "d long, t string")
    items = spark.createDataFrame([(1, "believable story of measured res"), (2, "able"), (3, "b c"), (4, ""), (5, "STORY  of measured"), (6, None), (7, "thing of i")], "i long, p string")
    assert {tuple(r) for r in E.find_passages(docs, items, "d", "t", "i", "p").collect()} == {(1, 1), (1, 2), (1, 5), (2, 7), (3, 3)}


def test_chunks_are_counted_by_their_whole_text():
    pieces = [C.Piece([0]), C.Piece([1]), C.Piece([2])]
    tokens = lambda n: -(-n // 4)
    merged = C.merge_small(pieces, {0: 5, 1: 5, 2: 2}, 3, 3, {}, tokens)  # 2 + 2 + 1 tokens apart, 3 together
    assert [p.lines for p in merged] == [[0, 1, 2]]


def test_words_of_a_line_are_letters_alone(spark):
    from tessera.functions import text as T

    got = spark.createDataFrame([("d'e a-b don't well-known x ½¾ Ⅻab c3po été",)], "c string").select(F.regexp_extract_all("c", F.lit(T.WORD), F.lit(0))).first()[0]
    assert got == re.findall(r"[^\W\d_][^\W\d_'\-]{1,}", "d'e a-b don't well-known x ½¾ Ⅻab c3po été")


def test_guards(spark):
    row = spark.createDataFrame([("IR Range", "from 4000 to 400", "  Alpha   BETA ", "C", "12.50 mg")], "a string, b string, c string, d string, v string")
    got = row.select(
        K.bad_range(F.col("a"), F.lit(None), F.lit(None), F.lit(None)), K.bad_range(F.lit("x"), F.col("b"), F.lit(None), F.lit(None)), K.bad_range(F.lit("total"), F.lit(None), F.lit(None), F.lit("s")),
        K.is_technical(F.lit("The Instrument-X"), F.lit(None)), K.is_technical(F.lit("a person")), K.is_absence(F.lit("Method: not specified.")), K.instance_signature(F.col("c"), F.col("d")) == K.instance_signature(F.lit("alpha beta"), F.lit("c ")),
        K.quantity_signature(F.lit("Mass"), F.col("v"), F.lit("MG")) == K.quantity_signature(F.lit("mass "), F.lit("12.5"), F.lit("mg")), K.quantity_signature(F.lit("Mass"), F.lit("none"), F.lit("mg")).isNull(),
        K.looks_like_file(F.lit("spectrum.dx")), K.looks_like_file(F.lit("a\\b")), K.looks_like_file(F.lit("v. 1.5")), K.looks_like_file(F.lit("sample")),
    ).first()
    assert list(got) == [True, True, False, True, False, True, True, True, True, True, True, False, False]


def test_graph_backup(spark, tmp_path):
    nodes = spark.createDataFrame([("a", ["T"], {"k": ["v"]})], "uri string, rdf_types array<string>, properties map<string,array<string>>")
    edges = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    for _ in range(2):
        G.backup(nodes, edges, str(tmp_path / "b"))
    got = G.restore(spark, str(tmp_path / "b"))
    assert got[0].collect() == nodes.collect() and got[1].collect() == edges.collect()


def test_profile_registry(spark, tmp_path):
    from tessera.sources import profiles

    path = str(tmp_path / "profiles")
    assert profiles.names(spark, path) == [] and profiles.get(spark, path, "a") is None and not profiles.delete(spark, path, "a")
    profiles.save(spark, path, "b.1", {"title": "B"})
    profiles.save(spark, path, "a", {"title": "A"})
    profiles.save(spark, path, "a", {"title": "A2", "x": [1]})
    assert profiles.names(spark, path) == ["a", "b.1"] and profiles.get(spark, path, "a") == {"title": "A2", "x": [1]}
    assert profiles.delete(spark, path, "a") and profiles.names(spark, path) == ["b.1"]
    for bad in ("", "..", "a/b", ".x", "a b"):
        with pytest.raises(ValueError):
            profiles.save(spark, path, bad, {})


def test_retries():
    calls, waits = [], []

    def fail(n):
        calls.append(n)
        if len(calls) < n:
            raise OSError("again")
        return "done"

    assert recovery.with_retries(fail, sleep=waits.append, most=3.0)(4) == "done" and waits == [1.0, 2.0, 3.0]
    calls.clear()
    with pytest.raises(OSError):
        recovery.with_retries(fail, attempts=2, sleep=waits.append)(9)
    with pytest.raises(ValueError):
        recovery.with_retries(lambda: int("x"), sleep=waits.append)()


def test_state_goes_on_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "package string, chunk long, text string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    many = [("r", 1, f"t{k}") for k in range(500)]
    written = []
    for part in ([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "a"), ("q", 1, "a"), *many], [("p", 3, "b"), ("p", 3, "c"), ("r", 2, "t1"), ("r", 2, "new")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        made = recovery.accumulate(stream, "package", "chunk", "text")
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive
        shown = recovery.progress(spark, q).collect()
        assert shown[-1].status == "completed" and any(r.rows > 0 for r in shown)
        written.append(sum(o["numRowsUpdated"] for p in q.recentProgress for o in (p if isinstance(p, dict) else json.loads(p.json))["stateOperators"]))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 1, 0, 2), ("p", 2, 2, 0), ("p", 3, 2, 1), ("q", 1, 0, 1), ("r", 1, 0, 500), ("r", 2, 500, 1)]
    assert written[1] < 20 < written[0]  # what the second batch adds, not what is known


def test_whole_chunking_keeps_what_passes(spark):
    lines = [f"This is line {k} of a text with enough words in it." for k in range(60)]
    lines[5:9] = ["-" * 40] * 4
    docs = spark.createDataFrame([("d", "\n".join(lines)), ("e", ""), ("f", None)], "doc_id string, text string")
    for strategy, more in (("fixed", {}), ("semantic", {"min_lines": 5})):
        got = sorted(C.chunk_documents(docs, strategy, 120, 20, 32, **more).collect(), key=lambda r: (r.doc_id, r.chunk_no))
        assert {r.doc_id for r in got} == {"d"} and got[0].start == 0 and got[-1].end == 59
        assert all(r.tokens <= 120 for r in got) and sum(r.n_lines for r in got) >= 56
    with pytest.raises(ValueError):
        C.chunk_documents(docs, "other")

"""Queries over archives, spreadsheets, PDF pages and RDF files that are made from the tables."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators.checkpoint import shared_folder
from tessera.sources import archives as A
from tessera.sources import packages as P
from tessera.sources import vocabularies as V
from tessera.plans.base import query, table
from tessera.plans.chunks import merging_sql
from tessera.plans.text import _QUALITY


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _archives(spark, sf):
    """One archive for each region: a file for each nation, in two nested archives if its key is odd, an image, and a broken archive."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        members = []
        for key, name in sorted(zip(pdf["n_nationkey"], pdf["n_name"], strict=True)):
            data = f"nation {name}\n".encode()
            members.append((f"n/{key}.txt", data) if key % 2 == 0 else (f"n/{key}.zip", _zip([(f"in/{key}.zip", _zip([(f"{key}.TXT", data), ("d/", b"")]))])))
        region = int(pdf["n_regionkey"].iloc[0])
        return pd.DataFrame([(f"/x/r{region}.zip", _zip([*members, ("pic.png", b"\x89PNG"), ("bad.zip", b"no archive")]))], columns=["path", "content"])

    return table(spark, sf, "nation").groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


_MEMBERS = """m AS (SELECT '/x/r' || n_regionkey || '.zip' AS archive, CASE WHEN n_nationkey % 2 = 0 THEN 'n/' || n_nationkey || '.txt' ELSE 'n/' || n_nationkey || '.zip/in/' || n_nationkey || '.zip/' || n_nationkey || '.TXT' END AS file_path, 'nation ' || n_name || chr(10) AS text FROM nation
  UNION ALL SELECT '/x/r' || r_regionkey || '.zip', 'pic.png', '[image: pic.png]' FROM region)"""


@query(f"WITH {_MEMBERS} SELECT archive, file_path, list_last(string_split(file_path, '/')) AS file_name, text, NULL AS error FROM m UNION ALL SELECT '/x/r' || r_regionkey || '.zip', 'bad.zip', 'bad.zip', NULL, 'not an archive: File is not a zip file' FROM region")
def archive_texts(spark, sf):
    return A.with_text(A.read_archives(_archives(spark, sf))).select("archive", "file_path", "file_name", "text", "error")


@query(
    f"WITH {_MEMBERS} SELECT archive, file_path, CASE WHEN file_path = 'pic.png' THEN 4 ELSE strlen(text) END AS byte_size, CASE WHEN file_path = 'pic.png' THEN 'image' ELSE 'plain_text' END AS file_type, file_path <> 'pic.png' AS is_chunkable FROM m UNION ALL SELECT '/x/r' || r_regionkey || '.zip', 'bad.zip', NULL, 'archive', true FROM region"
)
def archive_inventory(spark, sf):
    return A.inventory(A.read_archives(_archives(spark, sf))).select("archive", "file_path", "byte_size", "file_type", "is_chunkable")


@query(
    f"""WITH {_MEMBERS}, p AS (SELECT archive, list(file_path ORDER BY file_path) AS paths, count(*) AS n_files FROM m GROUP BY archive) SELECT archive, substr(sha256(regexp_replace(list_last(string_split(archive, '/')), '\\.zip$', '') || array_to_string(paths, '')), 1, 8) AS data_package_id, n_files FROM p"""
)
def archive_packages(spark, sf):
    return A.packages(A.read_archives(_archives(spark, sf)))


@query(
    "SELECT lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, CAST(doc_id AS VARCHAR) || '.txt' AS file_name, 'plain_text' AS file_type, octet_length(encode(coalesce(text, ''))) AS byte_size, sha256(coalesce(text, '')) AS digest FROM documents"
)
def package_members(spark, sf):
    """Documents written as packages by many tasks and read back by offset."""
    P.register(spark)
    docs = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw_content"))
    at = shared_folder(spark, "packages")
    docs.write.format("package").mode("append").save(at)
    back = spark.read.format("package").option("path", at).option("partitionMembers", 500).load()
    return A.inventory(back.withColumn("digest", F.sha2("raw_content", 256)), "digest").select("file_path", "file_name", "file_type", "byte_size", "digest")


def _xlsx(rows: list[list], name: str) -> bytes:
    cell = lambda c, k, v: f'<c r="{c}{k}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{k}"><v>{v}</v></c>'
    body = "".join(f'<row r="{k}">{"".join(cell(c, k, v) for c, v in zip("ABC", row))}</row>' for k, row in enumerate(rows, 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    book = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/><sheet name="empty" sheetId="2" r:id="rId2"/></sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2))
    return _zip([
        ("xl/workbook.xml", book.encode()), ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'.encode()),
        ("xl/worksheets/sheet1.xml", sheet.encode()), ("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>'.encode()),
    ])


def _ods(rows: list[list], name: str) -> bytes:
    space = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda v: f"<table:table-cell><text:p>{v}</text:p></table:table-cell>" if isinstance(v, str) else f'<table:table-cell office:value-type="float" office:value="{v}"><text:p>{v}</text:p></table:table-cell>'
    body = "".join(f'<table:table-row>{"".join(map(cell, row))}<table:table-cell table:number-columns-repeated="16000"/></table:table-row>' for row in rows)
    tail = '<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    return _zip([("content.xml", f'<office:document-content {space}><office:body><office:spreadsheet><table:table table:name="{name}">{body}{tail}</table:table></office:spreadsheet></office:body></office:document-content>'.encode())])


def _sheets(spark, sf):
    """Nations of each region as a workbook of both kinds: a header, the keys and names, and four rows of numbers."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [["key", "name"], *([int(k), n] for k, n in sorted(zip(pdf["n_nationkey"], pdf["n_name"], strict=True))), *([k, k * k] for k in range(1, 5))]
        region = int(pdf["n_regionkey"].iloc[0])
        made = [(f"r{region}.xlsx", _xlsx(rows, f"R{region}")), (f"r{region}.ods", _ods(rows, f"R{region}"))]
        return pd.DataFrame([(n, d, None) for n, d in made], columns=["file_name", "raw_content", "error"])

    return table(spark, sf, "nation").groupBy("n_regionkey").applyInPandas(pack, "file_name string, raw_content binary, error string")


@query(
    """WITH t AS (SELECT n_regionkey AS r, string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY 1), s AS (SELECT r, ': R' || r || chr(10) || chr(10) || 'key,name' || chr(10) || body || '1,1' || chr(10) || '4,16' || chr(10) AS x FROM t)
    SELECT 'r' || r || '.xlsx' AS file_name, 'Sheet1/2' || x || repeat(chr(10), 3) || 'Sheet2/2: empty' || chr(10) || chr(10) AS text FROM s UNION ALL SELECT 'r' || r || '.ods', 'Sheet1/1' || x FROM s"""
)
def spreadsheet_texts(spark, sf):
    return A.with_text(_sheets(spark, sf)).select("file_name", "text")


def _pdf(lines: list[str]) -> bytes:
    """Two pages: the first line on the first, in the clear, the others deflated on the second."""
    escaped = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    shown = lambda part: ("BT /F1 12 Tf " + " ".join(f"0 -14 Td ({escaped(x)}) Tj" for x in part) + " ET").encode("cp1252")
    packed = zlib.compress(shown(lines[1:]))
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(shown(lines[:1])), shown(lines[:1])), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>"


@query("SELECT 'r' || r_regionkey || '.pdf' AS file_name, 'Region (' || r_name || ')' || chr(10) || string_agg(n_name || ' \\ é', chr(10) ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def pdf_texts(spark, sf):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("n_nationkey")
        lines = [f"Region ({own['r_name'].iloc[0]})", *(f"{n} \\ é" for n in own["n_name"])]
        return pd.DataFrame([(f"r{int(own['n_regionkey'].iloc[0])}.pdf", _pdf(lines), None)], columns=["file_name", "raw_content", "error"])

    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.with_text(joined.groupBy("r_regionkey").applyInPandas(pack, "file_name string, raw_content binary, error string")).select("file_name", "text")


@query(
    """WITH n AS (SELECT n_regionkey AS r, 'http://e.org/n' || n_nationkey AS s, n_name FROM nation), t AS (SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://e.org/Nation' AS o, 'iri' AS o_kind, NULL AS o_lang, NULL AS o_datatype FROM n UNION ALL SELECT s, 'http://e.org/label', n_name, 'literal', 'en', NULL FROM n
    UNION ALL SELECT s, 'http://e.org/label', n_name || '"' || chr(10), 'literal', NULL, 'http://e.org/t' FROM n UNION ALL SELECT s, 'http://e.org/in', 'http://e.org/r' || r, 'iri', NULL, NULL FROM n UNION ALL SELECT 'http://e.org/r' || r_regionkey, 'http://e.org/key', CAST(r_regionkey AS VARCHAR), 'literal', NULL, 'http://www.w3.org/2001/XMLSchema#integer' FROM region
    UNION ALL SELECT 'http://e.org/r' || r_regionkey, 'http://e.org/label', r_name, 'literal', 'en', NULL FROM region)
    SELECT *, NULL AS failed FROM t UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, unnest(['/x.docx', '/y.ttl'])"""
)
def rdf_triples(spark, sf):
    """Regions with their nations as Turtle, the regions' labels as RDF/XML, a file of another kind and a broken one, which give a row each with their path."""
    n = table(spark, sf, "nation")
    about = F.concat(F.lit("e:n"), F.col("n_nationkey").cast("string"), F.lit(' a e:Nation ; e:label "'), "n_name", F.lit('"@en , """'), "n_name", F.lit('\\"\n"""^^e:t ;\n e:in e:r'), F.col("n_regionkey").cast("string"), F.lit(" .\n"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(about), "# next\n").alias("body"))
    key = F.col("n_regionkey").cast("string")
    turtle = body.select(F.concat(F.lit("/r"), key, F.lit(".ttl")).alias("path"), F.concat(F.lit("@prefix e: <http://e.org/> .\n"), "body", F.lit("e:r"), key, F.lit(" e:key "), key, F.lit(" .")).alias("content"))
    xml = table(spark, sf, "region").select(
        F.concat(F.lit("/r"), F.col("r_regionkey").cast("string"), F.lit(".rdf")).alias("path"),
        F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/"><rdf:Description rdf:about="http://e.org/r'), F.col("r_regionkey").cast("string"), F.lit('"><e:label xml:lang="en">'), "r_name", F.lit("</e:label></rdf:Description></rdf:RDF>")).alias("content"),
    )
    other = spark.createDataFrame([("/x.docx", "no triples"), ("/y.ttl", "<a> <b>")], "path string, content string")
    return V.read_rdf(turtle.unionByName(xml).unionByName(other)).select("s", "p", "o", "o_kind", "o_lang", "o_datatype", F.when(F.col("error").isNotNull(), F.col("path")).alias("failed"))


@query(
    "SELECT * FROM (VALUES ('https://w3id.org/nfdi4cat/voc4cat', 'https://nfdi4cat.github.io/voc4cat/v2026-02-24/voc4cat.ttl'), ('http://qudt.org/vocab/quantitykind', 'https://qudt.org/vocab/quantitykind/'), ('http://qudt.org/vocab/unit', 'https://qudt.org/vocab/unit/'), ('http://qudt.org/vocab/constant', 'https://qudt.org/vocab/constant')) t(identifier, source)"
)
def initial_vocabularies(spark, sf):
    return V.initial_vocabularies(spark)


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://raw.githubusercontent.com/o/r/main/a/' || page_id || '.yaml' WHEN 1 THEN 'https://github.com/o/r/tree/main/' || page_id ELSE url END AS address FROM pages"""
)
def raw_addresses(spark, sf):
    k = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/o/r/blob/main/a/"), k, F.lit(".yaml"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://github.com/o/r/tree/main/"), k)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", V.raw_address_column(url).alias("address"))


_KEPT = f"""WITH RECURSIVE {_QUALITY}, t AS (SELECT lines.doc_id, row_number() OVER (PARTITION BY lines.doc_id ORDER BY lines.line_no) - 1 AS i, lines.line_no, length(line) + 1 AS chars, CAST(ceil((length(line) + 1) / 4) AS BIGINT) AS n FROM lines JOIN gate ON gate.doc_id = lines.doc_id AND gate.line_no = lines.line_no WHERE kind = 'keep'),
    p AS (SELECT doc_id, i, CASE WHEN n > 64 THEN 0 ELSE n END AS open, CAST(0 AS BIGINT) AS chunk, CAST(CASE WHEN n > 64 THEN 1 ELSE 0 END AS BIGINT) AS nxt FROM t WHERE i = 0
      UNION ALL SELECT t.doc_id, t.i, CASE WHEN t.n > 64 THEN 0 WHEN p.open > 0 AND p.open + t.n > 64 THEN t.n ELSE p.open + t.n END, CAST(p.nxt + CASE WHEN p.open > 0 AND p.open + t.n > 64 THEN 1 ELSE 0 END AS BIGINT),
        CAST(p.nxt + CASE WHEN p.open > 0 AND p.open + t.n > 64 THEN 1 ELSE 0 END + CASE WHEN t.n > 64 THEN 1 ELSE 0 END AS BIGINT) FROM p JOIN t ON t.doc_id = p.doc_id AND t.i = p.i + 1),
    c AS (SELECT p.doc_id, chunk, min(t.line_no) AS a, max(t.line_no) AS b, count(*) AS lines, CAST(sum(t.chars) AS BIGINT) AS chars FROM p JOIN t ON p.doc_id = t.doc_id AND p.i = t.i GROUP BY ALL),"""


@query(_KEPT + merging_sql(16, 64))
def chunked_documents(spark, sf):
    """The whole pass over documents whose kept lines are never more than 32 apart."""
    return C.chunk_documents(table(spark, sf, "documents"), "fixed", 64, 16, 32).withColumn("operations", F.array_join("operations", ","))

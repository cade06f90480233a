"""What has no limit any more: empty runs in sheets, configurations of a run matrix."""

import io
import zipfile

from tessera.operators import reports
from tessera.sources import office

NAMES = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'


def sheet(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {NAMES}><table:table table:name="s">{body}</table:table></office:document-content>')
    return out.getvalue()


def cell(text="", times=1):
    return f'<table:table-cell table:number-columns-repeated="{times}">{f"<text:p>{text}</text:p>" if text else ""}</table:table-cell>'


def row(*cells, times=1):
    return f'<table:table-row table:number-rows-repeated="{times}">{"".join(cells)}</table:table-row>'


def test_empty_runs_count_where_something_follows():
    body = row(cell("a"), cell(times=1500), cell("b"), cell(times=16000)) + row(cell(times=5), times=1200) + row(cell("c", 2)) + row(cell(times=1000), times=1_000_000)
    [(name, rows)] = office.ods_sheets(sheet(body))
    assert name == "s" and len(rows) == 1202 and rows[0] == ["a", *[""] * 1500, "b"] and rows[1:1201] == [[]] * 1200 and rows[1201] == ["c", "c"]
    assert office.ods_sheets(sheet(row(cell(times=9), times=9))) == [("s", [])]


def test_run_matrix_of_any_size(spark, monkeypatch):
    left, right = spark.range(37).withColumnRenamed("id", "a"), spark.range(23).selectExpr("id AS b", "CAST(id AS STRING) AS `c.d`")
    want = sorted((a, b, str(b)) for a in range(37) for b in range(23))
    assert sorted(map(tuple, reports.run_matrix(left, right).collect())) == want
    monkeypatch.setattr(reports, "SHORT", 5)
    assert sorted(map(tuple, reports.run_matrix(left, right).collect())) == want
    assert reports.run_matrix(left, right.filter("false")).collect() == []

"""Texts of spreadsheets and PDF files, by the standard library alone."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ODF = {"table": "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "office": "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "text": "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"}


def _column(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of an Office Open XML workbook; formulas count as their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            rows: list[list[str]] = []
            for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(re.match(r"[A-Z]+", c.get("r"))[0]) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                    elif value is None or value.text is None:
                        cells.append("")
                    elif c.get("t") == "s":
                        cells.append(shared[int(value.text)])
                    elif c.get("t") == "b":
                        cells.append("True" if value.text == "1" else "False")
                    else:
                        cells.append(value.text)
                number = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(cells)
            out.append((sheet.get("name"), rows))
        return out


def ods_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of an OpenDocument spreadsheet."""
    t, o, x = _ODF["table"], _ODF["office"], _ODF["text"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))
    out = []
    for sheet in root.iter(f"{t}table"):
        rows: list[list[str]] = []
        skipped = 0
        for row in sheet.iter(f"{t}table-row"):
            cells: list[str] = []
            blank = 0
            for c in row:
                if c.tag not in (f"{t}table-cell", f"{t}covered-table-cell"):
                    continue
                number = c.get(f"{o}value")
                value = number if number is not None else "\n".join("".join(p.itertext()) for p in c.iter(f"{x}p"))
                times = int(c.get(f"{t}number-columns-repeated", 1))
                if value:  # empty cells count where something follows; a row may end in millions of them
                    cells += [""] * blank + [value] * times
                    blank = 0
                else:
                    blank += times
            times = int(row.get(f"{t}number-rows-repeated", 1))
            if cells:
                rows += [[] for _ in range(skipped)] + [list(cells) for _ in range(times)]
                skipped = 0
            else:
                skipped += times
        out.append((sheet.get(f"{t}name"), rows))
    return out


def sheets_of(data: bytes, extension: str) -> list[tuple[str, list[list[str]]]]:
    """Sheets of a spreadsheet; ValueError for what isn't one (or is of the old binary kind)."""
    try:
        return ods_sheets(data) if extension == "ods" else xlsx_sheets(data)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError) as e:
        raise ValueError(f"not a spreadsheet: {type(e).__name__}: {e}") from e


def sheets_text(sheets: list[tuple[str, list[list[str]]]], keep=lambda rows: rows) -> str:
    """All sheets as CSV under headings; ``keep`` chooses among the rows below a sheet's first one, its header."""
    parts = []
    for k, (name, rows) in enumerate(sheets, 1):
        out = io.StringIO()
        width = max((len(r) for r in rows), default=0)
        even = [r + [""] * (width - len(r)) for r in rows]
        csv.writer(out, lineterminator="\n").writerows([*even[:1], *keep(even[1:])])
        parts.append(f"Sheet{k}/{len(sheets)}: {name}\n\n{out.getvalue()}")
    return "\n\n\n".join(parts)


# ---------------------------------------------------------------- PDF

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(
    rb"""\((?P<text>(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<op>\b(?:Tj|TJ|Td|TD|T\*|Tm|ET|BT|Tf)\b|T\*|['"])|/(?P<name>[^\s/\[\]()<>]+)|(?P<number>[-+]?\d*\.?\d+)|[\[\]]""", re.S
)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPED.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def _inflated(body: bytes) -> bytes | None:
    m = _STREAM.search(body)
    if m is None:
        return None
    head = body[: m.start()]
    if b"FlateDecode" not in head:
        return m[1] if b"/Filter" not in head else None
    d = zlib.decompressobj()
    try:
        return d.decompress(m[1])
    except zlib.error:
        return None


def _to_unicode(table: bytes) -> dict[int, str]:
    """Codes and texts of a font's character map."""
    out: dict[int, str] = {}
    word = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = word(text)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for low, high, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = word(text)
            for k in range(min(int(high, 16) - int(low, 16) + 1, 65_536)):
                out[int(low, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def pdf_text(data: bytes) -> str:
    """The text that the content streams of all pages show, a line for each move to another line.

    Plain and deflated streams, object streams and fonts with a character map are read; encrypted files and
    scanned pages have none. ValueError for what isn't a PDF file.
    """
    if not data.lstrip()[:5].startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    objects = {int(n): body for n, _, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        if b"/ObjStm" in body and (held := _inflated(body)) is not None:
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            pairs = list(map(int, held[:first].split()))
            places = [*pairs[1::2], len(held) - first]
            objects |= {n: held[first + a : first + b] for n, a, b in zip(pairs[::2], places, places[1:], strict=False)}
    refs = lambda body, name: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1])]

    def pages(n: int, seen: set[int]) -> list[int]:
        body = objects.get(n, b"")
        if n in seen:
            return []
        seen.add(n)
        return [p for k in refs(body, b"Kids") for p in pages(k, seen)] if b"/Kids" in body else [n]

    roots = [n for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for n in refs(body, b"Pages")]
    order = [p for r in roots for p in pages(r, set())] or [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]
    maps: dict[int, dict[int, str]] = {}

    def fonts(page: int) -> dict[bytes, dict[int, str]]:
        body = objects.get(page, b"")
        for n in refs(body, b"Resources"):
            body += objects.get(n, b"")
        for n in refs(body, b"Font"):
            body += objects.get(n, b"")
        own = {}
        for name, ref in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", body):
            for t in refs(objects.get(int(ref), b""), b"ToUnicode"):
                if t not in maps:
                    maps[t] = _to_unicode(_inflated(objects.get(t, b"")) or b"")
                own[name] = maps[t]
        return own

    out = []
    for page in order:
        known, font, lines, line, pending = fonts(page), {}, [], [], []
        for n in refs(objects.get(page, b""), b"Contents"):
            for m in _SHOWN.finditer(_inflated(objects.get(n, b"")) or b""):
                if m["text"] is not None or m["hex"] is not None:
                    raw = _literal(m["text"]) if m["text"] is not None else bytes.fromhex("".join((h := m["hex"].decode()).split()) + "0" * (len("".join(h.split())) % 2))
                    if font:
                        wide = max(font, default=0) > 255
                        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if wide else list(raw)
                        pending.append("".join(font.get(c, "") for c in codes))
                    else:
                        pending.append(raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace"))
                elif m["number"] is not None:
                    if pending and float(m["number"]) < -180:  # a wide gap between pieces of a line
                        pending.append(" ")
                elif m["name"] is not None:
                    font = known.get(m["name"], font)
                elif m["op"] in (b"Tj", b"TJ", b"'", b'"'):
                    if m["op"] in (b"'", b'"') and line:
                        lines.append("".join(line))
                        line = []
                    line += pending
                    pending = []
                elif m["op"] in (b"Td", b"TD", b"T*", b"Tm", b"ET") and line:
                    lines.append("".join(line))
                    line, pending = [], []
                elif m["op"] is not None:
                    pending = []
        if line:
            lines.append("".join(line))
        out.append("\n".join(x.rstrip() for x in lines))
    return "\n".join(out)

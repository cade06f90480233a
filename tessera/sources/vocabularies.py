"""RDF files, the usual vocabularies, and addresses of schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLES = "s string, p string, o string, o_kind string, o_lang string, o_datatype string"

#: Identifiers of the vocabularies that an installation starts with, and where they are published.
INITIAL = (
    ("https://w3id.org/nfdi4cat/voc4cat", "https://nfdi4cat.github.io/voc4cat/v2026-02-24/voc4cat.ttl"),
    ("http://qudt.org/vocab/quantitykind", "https://qudt.org/vocab/quantitykind/"),
    ("http://qudt.org/vocab/unit", "https://qudt.org/vocab/unit/"),
    ("http://qudt.org/vocab/constant", "https://qudt.org/vocab/constant"),
)


def initial_vocabularies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INITIAL), "identifier string, source string")


def raw_address(url: str) -> str:
    """The address of a file's bytes for the address of its page on a code host; others as they are."""
    u = urlparse(url)
    parts = [p for p in u.path.split("/") if p]
    if u.scheme in ("http", "https") and u.netloc.lower() == "github.com" and len(parts) >= 5 and parts[2] in ("blob", "raw"):
        return "/".join(["https://raw.githubusercontent.com", *parts[:2], *parts[3:]])
    return url


def raw_address_column(url):
    """``raw_address`` as a column."""
    hit = r"^https?://(?i:github\.com)/+([^/?#]+)/+([^/?#]+)/+(?:blob|raw)/+([^/?#]+)/+([^?#]*[^/?#])/*(?:[?#].*)?$"
    return F.when(url.rlike(hit), F.regexp_replace(url, hit, "https://raw.githubusercontent.com/$1/$2/$3/$4")).otherwise(url)


class TurtleError(ValueError):
    """Text that isn't Turtle."""


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)"""
    r"""|(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:%]|\\.)(?:(?:[\w.\-:%]|\\.)*(?:[\w\-:%]|\\.))?)?)|(?P<word>[A-Za-z]+)|(?P<sign>[.;,\[\]()])""",
    re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S) if "\\" in text else text


class Turtle:
    """A reader of one Turtle document: directives, prefixed names, lists of predicates and objects, nested blank nodes, collections, abbreviated numbers."""

    def __init__(self, text: str, base: str = ""):
        self.base, self.prefixes, self.made, self.out = base, {}, 0, []
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TurtleError(f"at {at}: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        found = self.peek()
        if found[0] == "end" or sign is not None and found[1] != sign:
            raise TurtleError(f"{sign or 'more'} expected, not {found[1]!r}")
        self.at += 1
        return found

    def blank(self) -> str:
        self.made += 1
        return f"_:made{self.made}"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            made = _unescaped(text[1:-1])
            return made if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", made) else urljoin(self.base, made)
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def subject(self) -> str:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, text)
        if kind == "blank":
            return text
        if text == "(":
            return self.collection()
        raise TurtleError(f"no subject: {text!r}")

    def predicates(self, subject: str) -> None:
        while True:
            kind, text = self.take()
            predicate = RDF + "type" if (kind, text) == ("word", "a") else self.iri(kind, text) if kind in ("iri", "name") else None
            if predicate is None:
                raise TurtleError(f"no predicate: {text!r}")
            while True:
                self.out.append((subject, predicate, *self.object()))
                if self.peek()[1] != "," or self.peek()[0] != "sign":
                    break
                self.take()
            while self.peek() == ("sign", ";"):
                self.take()
                if self.peek() in (("sign", "."), ("sign", "]"), ("end", "")):
                    return
                if self.peek() != ("sign", ";"):
                    break
            else:
                return

    def bracket(self) -> str:
        node = self.blank()
        if self.peek() != ("sign", "]"):
            self.predicates(node)
        self.take("]")
        return node

    def collection(self) -> str:
        items = []
        while self.peek() != ("sign", ")"):
            items.append(self.object())
        self.take(")")
        nodes = [self.blank() for _ in items]
        for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
            self.out.append((node, RDF + "first", *item))
            rest = nodes[k + 1] if k + 1 < len(nodes) else RDF + "nil"
            self.out.append((node, RDF + "rest", rest, "bnode" if rest.startswith("_:") else "iri", None, None))
        return nodes[0] if nodes else RDF + "nil"

    def object(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, text), "iri", None, None
        if kind == "blank":
            return text, "bnode", None, None
        if text in ("[", "("):
            node = self.bracket() if text == "[" else self.collection()
            return node, "bnode" if node.startswith("_:") else "iri", None, None
        if kind == "number":
            return text, "literal", None, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if (kind, text) in (("word", "true"), ("word", "false")):
            return text, "literal", None, XSD + "boolean"
        if kind not in ("string", "long"):
            raise TurtleError(f"no object: {text!r}")
        value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
        after, tag = self.peek()
        if after == "lang":
            self.take()
            return value, "literal", tag[1:], None
        if after == "type":
            self.take()
            return value, "literal", None, self.iri(*self.take())
        return value, "literal", None, None

    def read(self) -> list[tuple]:
        """(s, p, o, o_kind, o_lang, o_datatype) of every statement."""
        while self.at < len(self.tokens):
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if kind in ("lang", "word") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1]
                    self.prefixes[name.partition(":")[0]] = self.iri(*self.take())
                else:
                    self.base = self.iri(*self.take())
                if text.startswith("@"):
                    self.take(".")
                continue
            if text == "[":
                self.take()
                subject = self.bracket()
                if self.peek() != ("sign", "."):
                    self.predicates(subject)
            else:
                self.predicates(self.subject())
            self.take(".")
        return self.out


def read_rdf_xml(text: str, base: str = "") -> list[tuple]:
    """Statements of RDF/XML: typed nodes, property elements and attributes, resources, blank nodes, literals with language or datatype."""
    out, made = [], [0]
    lang_name = "{http://www.w3.org/XML/1998/namespace}lang"
    full = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank(name: str | None = None) -> str:
        made[0] += 1
        return f"_:{name}" if name else f"_:made{made[0]}"

    def node(e: ET.Element, lang: str | None) -> str:
        lang = e.get(lang_name, lang)
        about, ident = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID")
        s = urljoin(base, about) if about is not None else urljoin(base, "#" + ident) if ident else blank(e.get(f"{{{RDF}}}nodeID"))
        if full(e.tag) != RDF + "Description":
            out.append((s, RDF + "type", full(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/")):
                out.append((s, full(k), v, "literal", lang, None))
        for p in e:
            own, resource, name = p.get(lang_name, lang), p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}nodeID")
            if resource is not None:
                out.append((s, full(p.tag), urljoin(base, resource), "iri", None, None))
            elif name or p.get(f"{{{RDF}}}parseType") == "Resource" or len(p):
                if name:
                    o = blank(name)
                elif p.get(f"{{{RDF}}}parseType") == "Resource":
                    inner = ET.Element(f"{{{RDF}}}Description")
                    inner.extend(list(p))
                    o = node(inner, own)
                else:
                    o = node(p[0], own)
                out.append((s, full(p.tag), o, "bnode" if o.startswith("_:") else "iri", None, None))
            else:
                kind = p.get(f"{{{RDF}}}datatype")
                out.append((s, full(p.tag), p.text or "", "literal", None if kind else own, kind))
        return s

    root = ET.fromstring(text)
    for e in root if full(root.tag) == RDF + "RDF" else [root]:
        node(e, root.get(lang_name))
    return out


#: formats by extension
FORMATS = {"ttl": "turtle", "turtle": "turtle", "n3": "turtle", "nt": "turtle", "rdf": "xml", "xml": "xml", "owl": "xml"}


def triples_of(text: str, name: str) -> list[tuple]:
    """Statements of a file, by its extension; N-Triples are Turtle too. ValueError for other formats and malformed texts."""
    kind = FORMATS.get(name.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no RDF format for {name!r}")
    try:
        return Turtle(text).read() if kind == "turtle" else read_rdf_xml(text)
    except ET.ParseError as e:
        raise ValueError(str(e)) from e


def read_rdf(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, s, p, o, o_kind, o_lang, o_datatype, error) of RDF files; one that can't be read gives one row with ``error``. Blank nodes carry a mark of their file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf[path_col], pdf[content_col], strict=True):
                try:
                    text = data if isinstance(data, str) else bytes(data).decode("utf-8-sig")
                    own = [(path, *t, None) for t in triples_of(text, path)]
                except ValueError as e:
                    own = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                for at in range(0, len(own), 10_000):
                    yield pd.DataFrame(own[at : at + 10_000], columns=["path", "s", "p", "o", "o_kind", "o_lang", "o_datatype", "error"])

    made = files.select(path_col, content_col).mapInPandas(run, f"path string, {TRIPLES}, error string")
    mark = F.concat(F.lit("_:"), F.substring(F.sha1("path"), 1, 8), F.lit("-"))
    name = lambda c: F.when(F.col(c).startswith("_:"), F.concat(mark, F.expr(f"substring({c}, 3)"))).otherwise(F.col(c))
    return made.withColumn("s", name("s")).withColumn("o", F.when(F.col("o_kind") == "bnode", name("o")).otherwise(F.col("o")))

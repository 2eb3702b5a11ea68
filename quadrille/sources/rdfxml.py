"""RDF/XML documents: a reader for one file a task, and a writer for small graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrille.sources.quads import SCHEMA
from quadrille.sources.rdf import RdfSyntaxError, _stable
from quadrille.terms import FIRST, NIL, RDF, REST, TYPE, iri, kind, literal, parse_literal

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"
#: Names of the syntax itself, which are no property attributes.
_SYNTAX = {f"{_R}{n}" for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "RDF", "Description", "li")}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class RdfXmlParser:
    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.root, self.base, self.scope = ET.fromstring(text), base, scope
        self.triples: list[tuple[str, str, str]] = []
        self.fresh = count()

    def parse(self) -> list[tuple[str, str, str, None]]:
        if self.root.tag == f"{_R}RDF":
            for node in self.root:
                self._node(node, self.root.get(f"{_XML}base", self.base), self.root.get(f"{_XML}lang", ""))
        else:
            self._node(self.root, self.base, "")
        return [(*t, None) for t in self.triples]

    def _blank(self, name: str | None = None) -> str:
        return f"_:{self.scope}n{name}" if name else f"_:{self.scope}g{next(self.fresh)}"

    def _node(self, e: ET.Element, base: str, lang: str) -> str:
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        if (about := e.get(f"{_R}about")) is not None:
            s = iri(urljoin(base, about))
        elif name := e.get(f"{_R}ID"):
            s = iri(urljoin(base, f"#{name}"))
        else:
            s = self._blank(e.get(f"{_R}nodeID"))
        if e.tag != f"{_R}Description":
            self.triples.append((s, TYPE, iri(_name(e.tag))))
        self._attributes(s, e, base, lang)
        members = count(1)
        for child in e:
            self._property(s, child, base, lang, members)
        return s

    def _attributes(self, s: str, e: ET.Element, base: str, lang: str) -> bool:
        some = False
        for k, v in e.attrib.items():
            if k in _SYNTAX or k.startswith(_XML) or not k.startswith("{"):
                continue
            some = True
            self.triples.append((s, TYPE, iri(urljoin(base, v))) if k == f"{_R}type" else (s, iri(_name(k)), literal(v, lang=lang)))
        return some

    def _property(self, s: str, e: ET.Element, base: str, lang: str, members: Iterator[int]) -> None:
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        p = iri(f"{RDF}_{next(members)}") if e.tag == f"{_R}li" else iri(_name(e.tag))
        form = e.get(f"{_R}parseType")
        if form == "Resource":
            o = self._blank()
            inner = count(1)
            for child in e:
                self._property(o, child, base, lang, inner)
        elif form == "Collection":
            items = [self._node(child, base, lang) for child in e]
            o = NIL
            for item in reversed(items):
                cell = self._blank()
                self.triples += [(cell, FIRST, item), (cell, REST, o)]
                o = cell
        elif form is not None:
            inside = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            o = literal(inside, f"{RDF}XMLLiteral")
        elif len(e):
            if len(e) > 1:
                raise RdfSyntaxError(f"more than one node in {e.tag}")
            o = self._node(e[0], base, lang)
        elif (resource := e.get(f"{_R}resource")) is not None or e.get(f"{_R}nodeID"):
            o = iri(urljoin(base, resource)) if resource is not None else self._blank(e.get(f"{_R}nodeID"))
            self._attributes(o, e, base, lang)
        elif any(k.startswith("{") and k not in _SYNTAX and not k.startswith(_XML) for k in e.attrib):
            o = self._blank()
            self._attributes(o, e, base, lang)
        else:
            datatype = e.get(f"{_R}datatype")
            o = literal(e.text or "", urljoin(base, datatype)) if datatype else literal(e.text or "", lang=lang)
        self.triples.append((s, p, o))
        if name := e.get(f"{_R}ID"):
            statement = iri(urljoin(base, f"#{name}"))
            self.triples += [(statement, TYPE, iri(f"{RDF}Statement")), *((statement, iri(f"{RDF}{n}"), x) for n, x in (("subject", s), ("predicate", p), ("object", o)))]


def parse_rdfxml(text: str, base: str = "", scope: str = "") -> list[tuple[str, str, str, None]]:
    return RdfXmlParser(text, base, scope).parse()


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g) of RDF/XML files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(parse_rdfxml(bytes(content).decode("utf-8"), file, f"f{_stable(file):x}x"), columns=list("spog"))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def to_rdfxml(triples: list[tuple]) -> str:
    """RDF/XML of a small graph without triple terms; predicates have to end in an XML name."""
    ET.register_namespace("rdf", RDF)
    root = ET.Element(f"{_R}RDF")
    by_subject: dict[str, ET.Element] = {}
    for s, p, o in sorted(t[:3] for t in triples):
        if s not in by_subject:
            by_subject[s] = ET.SubElement(root, f"{_R}Description", {f"{_R}about": s[1:-1]} if s.startswith("<") else {f"{_R}nodeID": s[2:]})
        value = p[1:-1]
        cut = max(value.rfind("#"), value.rfind("/"), value.rfind(":")) + 1
        e = ET.SubElement(by_subject[s], f"{{{value[:cut]}}}{value[cut:]}")
        if kind(o) == "iri":
            e.set(f"{_R}resource", o[1:-1])
        elif kind(o) == "blank":
            e.set(f"{_R}nodeID", o[2:])
        else:
            lit = parse_literal(o)
            e.text = lit.lex
            if lit.lang:
                e.set(f"{_XML}lang", lit.lang)
            elif not lit.datatype.endswith("#string"):
                e.set(f"{_R}datatype", lit.datatype)
    return ET.tostring(root, encoding="unicode")

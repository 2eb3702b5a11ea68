"""RDF files: N-Triples and N-Quads by lines, Turtle and TriG by files; and writers.

Line formats are read by Spark's text source, so large files are split among tasks.
A Turtle document has to be read from its start: one task reads one file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.quads import SCHEMA
from quadrille.terms import FIRST, NIL, REIFIES, REST, TYPE, XSD, iri, literal, triple_parts, unescape

_NQ = re.compile(
    r'\s*(?:(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)|(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)|"(?P<lex>(?:[^"\\\n\r]|\\.)*)"(?:\^\^<(?P<dt>[^>]*)>|@(?P<tag>[A-Za-z]+(?:-[A-Za-z0-9]+)*)(?:--(?P<dir>ltr|rtl))?)?|(?P<open><<\()|(?P<close>\)>>)|(?P<dot>\.)|(?P<note>\#.*))'
)


class RdfSyntaxError(ValueError):
    pass


def parse_nquad(line: str, scope: str = "") -> tuple[str, str, str, str | None] | None:
    """One line as (s, p, o, g); None for a line without a statement.  ``scope`` keeps blank labels of different files apart."""
    stack: list[list[str]] = [[]]
    at, ended = 0, False
    while at < len(line):
        if line[at:].isspace():
            break
        m = _NQ.match(line, at)
        if not m or ended and not m["note"]:
            raise RdfSyntaxError(f"at {at}: {line[at : at + 40]!r}")
        at = m.end()
        if m["iri"]:
            stack[-1].append(iri(unescape(m["iri"][1:-1])))
        elif m["blank"]:
            stack[-1].append(f"_:{scope}{m['blank'][2:]}")
        elif m["lex"] is not None:
            stack[-1].append(literal(unescape(m["lex"]), m["dt"] or "", m["tag"] or "", m["dir"] or ""))
        elif m["open"]:
            stack.append([])
        elif m["close"]:
            parts = stack.pop()
            if len(parts) != 3 or not stack:
                raise RdfSyntaxError(line)
            stack[-1].append(f"<<( {' '.join(parts)} )>>")
        elif m["dot"]:
            ended = True
        else:
            break
    parts = stack[0]
    if not parts and not ended:
        return None
    if not ended or len(stack) != 1 or len(parts) not in (3, 4) or parts[0][0] == '"' or parts[1][0] != "<" or len(parts) == 4 and parts[3][0] == '"':
        raise RdfSyntaxError(line)
    return (*parts, None)[:4]


def read_nquads(spark: SparkSession, path: str, skip_errors: bool = False) -> DataFrame:
    """(s, p, o, g) of N-Triples or N-Quads files; lines that do not parse are skipped or stop the query.

    A blank label is one node within a file.  The part files of one folder, as Spark writes
    them, are one file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for line, file in zip(frame["value"], frame["file"]):
                try:
                    found = parse_nquad(line, f"f{_stable(_PART.sub('', file))}x")
                except RdfSyntaxError:
                    if not skip_errors:
                        raise
                    continue
                if found:
                    rows.append(found)
            yield pd.DataFrame(rows, columns=list("spog"))

    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return lines.mapInPandas(run, SCHEMA)


_PART = re.compile(r"/part-[^/]*$")


def _stable(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:20]


_TTL = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n\r]*)+)|(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)|(?P<string>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|@version\b|(?:prefix|base|version)(?=\s))|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)|(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>true|false|a|GRAPH|graph)\b|(?P<op><<\(|\)>>|<<|>>|\{\||\|\}|\^\^|[.;,\[\](){}~])""",
    re.X | re.S | re.I,
)


class TurtleParser:
    """Turtle and TriG documents, with triple terms, reifiers and annotations."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.text, self.base, self.scope = text, base, scope
        self.prefixes: dict[str, str] = {}
        self.quads: list[tuple[str, str, str, str | None]] = []
        self.graph: str | None = None
        self.fresh = count()
        self.at = 0
        self.kind, self.value = "", ""
        self._advance()

    def _advance(self) -> str:
        found = self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return found
            m = _TTL.match(self.text, self.at)
            if not m:
                raise RdfSyntaxError(f"at {self.at}: {self.text[self.at : self.at + 40]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return found

    def _op(self, op: str) -> bool:
        if self.kind == "op" and self.value == op:
            self._advance()
            return True
        return False

    def _need(self, op: str) -> None:
        if not self._op(op):
            raise RdfSyntaxError(f"expected {op!r} before {self.at}, found {self.value!r}")

    def parse(self) -> list[tuple[str, str, str, str | None]]:
        while self.kind != "end":
            if self.kind == "directive":
                self._directive()
            elif self.kind == "word" and self.value.upper() == "GRAPH":
                self._advance()
                self._block(self._term())
            elif self.kind == "op" and self.value == "{":
                self._block(None)
            else:
                self._statement()
        return self.quads

    def _directive(self) -> None:
        mark = self._advance()
        name = mark.lstrip("@").lower()
        if name == "prefix":
            prefix = self._advance()[:-1]
            self.prefixes[prefix] = self._resolve(self._advance()[1:-1])
        elif name == "base":
            self.base = self._resolve(self._advance()[1:-1])
        else:
            self._advance()
        if mark.startswith("@"):
            self._need(".")

    def _resolve(self, value: str) -> str:
        value = unescape(value)
        return urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value) else value

    def _block(self, graph: str | None) -> None:
        self._need("{")
        self.graph = graph
        while not self._op("}"):
            self._triples()
            if not self._op(".") and not (self.kind == "op" and self.value == "}"):
                raise RdfSyntaxError(f"expected '.' before {self.at}")
        self.graph = None

    def _statement(self) -> None:
        if self.kind in ("iri", "pname", "blank"):
            s = self._term()
            if self.kind == "op" and self.value == "{":
                self._block(s)
                return
            self._properties(s)
        else:
            self._triples()
        self._need(".")

    def _triples(self) -> None:
        alone = self.kind == "op" and self.value in ("[", "<<")
        s = self._node()
        if not (alone and self.kind == "op" and self.value in (".", "}")):
            self._properties(s)

    def _emit(self, s: str, p: str, o: str) -> None:
        self.quads.append((s, p, o, self.graph))

    def _verb(self) -> str:
        if self.kind == "word" and self.value == "a":
            self._advance()
            return TYPE
        return self._term()

    def _properties(self, s: str) -> None:
        while True:
            p = self._verb()
            while True:
                o = self._node()
                self._emit(s, p, o)
                self._annotations(s, p, o)
                if not self._op(","):
                    break
            if not self._op(";"):
                return
            while self._op(";"):
                pass
            if self.kind == "op" and self.value in (".", "]", "}", "|}"):
                return

    def _annotations(self, s: str, p: str, o: str) -> None:
        reifier = None
        while self.kind == "op" and self.value in ("~", "{|"):
            if self._op("~"):
                reifier = self._term() if self.kind in ("iri", "pname", "blank") else self._new()
                self._emit(reifier, REIFIES, f"<<( {s} {p} {o} )>>")
            else:
                self._advance()
                if reifier is None:
                    reifier = self._new()
                    self._emit(reifier, REIFIES, f"<<( {s} {p} {o} )>>")
                self._properties(reifier)
                self._need("|}")
                reifier = None

    def _new(self) -> str:
        return f"_:{self.scope}g{next(self.fresh)}"

    def _node(self) -> str:
        if self._op("["):
            node = self._new()
            if not self._op("]"):
                self._properties(node)
                self._need("]")
            return node
        if self._op("("):
            items = []
            while not self._op(")"):
                items.append(self._node())
            rest = NIL
            for item in reversed(items):
                node = self._new()
                self._emit(node, FIRST, item)
                self._emit(node, REST, rest)
                rest = node
            return rest
        if self._op("<<("):
            parts = [self._node(), self._verb(), self._node()]
            self._need(")>>")
            return f"<<( {' '.join(parts)} )>>"
        if self._op("<<"):
            parts = [self._node(), self._verb(), self._node()]
            reifier = (self._term() if self.kind in ("iri", "pname", "blank") else self._new()) if self._op("~") else self._new()
            self._need(">>")
            self._emit(reifier, REIFIES, f"<<( {' '.join(parts)} )>>")
            return reifier
        return self._term()

    def _term(self) -> str:
        kind, value = self.kind, self.value
        if kind not in ("iri", "pname", "blank", "string", "number", "word"):
            raise RdfSyntaxError(f"expected a term before {self.at}, found {value!r}")
        self._advance()
        if kind == "iri":
            return iri(self._resolve(value[1:-1]))
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise RdfSyntaxError(f"undeclared prefix {prefix!r}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return f"_:{self.scope}b{value[2:]}"
        if kind == "number":
            return literal(value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word":
            return literal(value.lower(), f"{XSD}boolean")
        quotes = 3 if value[:3] in ('"""', "'''") else 1
        lex = unescape(value[quotes:-quotes])
        if self.kind == "tag":
            tag, _, direction = self._advance()[1:].partition("--")
            return literal(lex, lang=tag, direction=direction)
        if self._op("^^"):
            return literal(lex, self._term()[1:-1])
        return literal(lex)


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[tuple[str, str, str, str | None]]:
    return TurtleParser(text, base, scope).parse()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g) of Turtle or TriG files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(parse_turtle(bytes(content).decode("utf-8"), file, f"f{_stable(file)}x"), columns=list("spog"))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, syntax: str | None = None) -> DataFrame:
    """Quads of files, by their ending or the syntax named."""
    kind = syntax or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("rdf", "xml", "rdfxml", "owl"):
        from quadrille.sources.rdfxml import read_rdfxml

        return read_rdfxml(spark, path)
    return read_turtle(spark, path) if kind in ("ttl", "trig", "turtle") else read_nquads(spark, path)


def nquads(df: DataFrame) -> DataFrame:
    """(value), a line for each quad; sorted and made distinct it is the canonical form."""
    columns = [c for c in ("s", "p", "o", "g") if c in df.columns]
    return df.select(F.concat_ws(" ", *columns, F.lit(".")).alias("value"))


def write_nquads(df: DataFrame, path: str) -> None:
    nquads(df).write.mode("overwrite").text(path)


def to_turtle(quads: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle or TriG of a small graph: prefixes, predicate and object lists."""
    prefixes = prefixes or {}

    def short(t: str) -> str:
        if t.startswith("<<("):
            return "<<( " + " ".join(map(short, triple_parts(t))) + " )>>"
        if t.startswith("<"):
            for p, namespace in prefixes.items():
                local = t[1 : 1 + len(namespace)] == namespace and t[1 + len(namespace) : -1]
                if local is not False and re.fullmatch(r"[A-Za-z_][\w\-]*", local):
                    return f"{p}:{local}"
        return t

    out = [f"@prefix {p}: <{n}> ." for p, n in prefixes.items()]
    by_graph: dict[str | None, dict[str, dict[str, list[str]]]] = {}
    for s, p, o, g in sorted({(*q, None)[:4] for q in quads}, key=lambda q: tuple(x or "" for x in (q[3], q[0], q[1], q[2]))):
        by_graph.setdefault(g, {}).setdefault(s, {}).setdefault(p, []).append(o)
    for g, subjects in by_graph.items():
        lines = [short(s) + " " + " ;\n    ".join(("a" if p == TYPE else short(p)) + " " + ", ".join(map(short, os)) for p, os in ps.items()) + " ." for s, ps in subjects.items()]
        out += lines if g is None else [f"{short(g)} {{", *lines, "}"]
    return "\n".join(out) + "\n"

"""RDF terms as canonical N-Triples strings, on the driver.

``<iri>``, ``_:label``, ``"lex"`` (a simple literal), ``"lex"^^<datatype>``,
``"lex"@tag``, ``"lex"@tag--dir`` and ``<<( s p o )>>``.  Equal strings are equal terms,
so joins, DISTINCT and GROUP BY need no code of their own.
"""

from __future__ import annotations

import re
from typing import NamedTuple

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = f"<{RDF}type>"
FIRST, REST, NIL = f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>"
REIFIES = f"<{RDF}reifies>"
#: Integer types of XSD with their bounds.
_B = (1 << 63) - 1
INTEGERS = {
    "integer": (-_B - 1, _B), "long": (-_B - 1, _B), "int": (-(1 << 31), (1 << 31) - 1), "short": (-(1 << 15), (1 << 15) - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, _B), "positiveInteger": (1, _B), "nonPositiveInteger": (-_B - 1, 0), "negativeInteger": (-_B - 1, -1),
    "unsignedLong": (0, _B), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedByte": (0, 255),
}

_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?)?$', re.S)
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}
_UNESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Literal(NamedTuple):
    lex: str
    datatype: str
    lang: str = ""
    direction: str = ""


def escape(lex: str) -> str:
    return re.sub(r'[\\"\n\r]', lambda m: _ESCAPES[m[0]], lex)


def unescape(lex: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _UNESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, lex, flags=re.S)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lex: str, datatype: str = "", lang: str = "", direction: str = "") -> str:
    if lang:
        return f'"{escape(lex)}"@{lang.lower()}' + (f"--{direction}" if direction else "")
    return f'"{escape(lex)}"' + (f"^^<{datatype}>" if datatype and datatype != f"{XSD}string" else "")


def typed(value) -> str:
    """The term of a Python value."""
    if isinstance(value, bool):
        return literal("true" if value else "false", f"{XSD}boolean")
    if isinstance(value, int):
        return literal(str(value), f"{XSD}integer")
    if isinstance(value, float):
        return literal(repr(value), f"{XSD}double")
    return literal(str(value))


def parse_literal(term: str) -> Literal | None:
    m = _LITERAL.match(term)
    if not m:
        return None
    kind = m[2] or (f"{RDF}dirLangString" if m[4] else f"{RDF}langString" if m[3] else f"{XSD}string")
    return Literal(unescape(m[1]), kind, m[3] or "", m[4] or "")


def kind(term: str) -> str:
    """iri, blank, literal or triple."""
    return "triple" if term.startswith("<<(") else {"<": "iri", "_": "blank", '"': "literal"}[term[0]]


def triple_parts(term: str) -> tuple[str, str, str] | None:
    """The parts of a triple term."""
    if not term.startswith("<<( "):
        return None
    parts, at, end = [], 4, len(term) - 4
    while at < end:
        if term.startswith("<<(", at):
            depth, k = 0, at
            while True:
                if term.startswith("<<(", k):
                    depth, k = depth + 1, k + 3
                elif term.startswith(")>>", k):
                    depth, k = depth - 1, k + 3
                    if not depth:
                        break
                elif term[k] == '"':
                    k = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(term, k).end()
                else:
                    k += 1
        elif term[at] == '"':
            k = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?', re.S).match(term, at).end()
        else:
            k = term.index(">", at) + 1 if term[at] == "<" else re.compile(r"\S+").match(term, at).end()
        parts.append(term[at:k])
        at = k + 1
    return tuple(parts) if len(parts) == 3 else None

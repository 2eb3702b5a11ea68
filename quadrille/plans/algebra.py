"""The query algebra: immutable nodes.

A term in a pattern is a string as in ``quadrille.terms``; a variable starts with ``?``.
Blank nodes in patterns are variables that start with ``?_:``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


# --- paths -------------------------------------------------------------------


@dataclass(frozen=True)
class Link(Node):
    iri: str


@dataclass(frozen=True)
class Inverse(Node):
    path: Node


@dataclass(frozen=True)
class Seq(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Alt(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Repeat(Node):
    """``*`` (zero, many), ``+`` (not zero, many), ``?`` (zero, not many)."""

    path: Node
    zero: bool
    many: bool


@dataclass(frozen=True)
class Negated(Node):
    forward: tuple[str, ...]
    backward: tuple[str, ...]


# --- expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Const(Node):
    term: str


@dataclass(frozen=True)
class Call(Node):
    """An operator or a built-in, by its upper-case name or symbol; functions by IRI as ``<iri>``."""

    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Exists(Node):
    pattern: Node
    negated: bool


@dataclass(frozen=True)
class Aggregate(Node):
    name: str
    arg: Node | None
    distinct: bool = False
    separator: str = " "


# --- patterns ----------------------------------------------------------------


@dataclass(frozen=True)
class Triple(Node):
    s: str
    p: str
    o: str


@dataclass(frozen=True)
class Bgp(Node):
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Path(Node):
    s: str
    path: Node
    o: str


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    condition: Node | None = None


@dataclass(frozen=True)
class Filter(Node):
    condition: Node
    inner: Node


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Extend(Node):
    inner: Node
    name: str
    value: Node


@dataclass(frozen=True)
class Values(Node):
    names: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Graph(Node):
    name: str
    inner: Node


@dataclass(frozen=True)
class Service(Node):
    name: str
    inner: Node
    silent: bool
    text: str = ""


@dataclass(frozen=True)
class Group(Node):
    inner: Node
    keys: tuple[tuple[str, Node], ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class OrderBy(Node):
    inner: Node
    keys: tuple[tuple[Node, bool], ...]  # (expression, descending)


@dataclass(frozen=True)
class Project(Node):
    inner: Node
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Node):
    inner: Node


@dataclass(frozen=True)
class Slice(Node):
    inner: Node
    offset: int
    limit: int | None


# --- queries and updates -----------------------------------------------------


@dataclass(frozen=True)
class Query(Node):
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    pattern: Node
    names: tuple[str, ...] = ()
    template: tuple[Triple, ...] = ()
    described: tuple[str, ...] = ()
    default_graphs: tuple[str, ...] | None = None
    named_graphs: tuple[str, ...] | None = None
    base: str = ""


@dataclass(frozen=True)
class QuadPattern(Node):
    s: str
    p: str
    o: str
    g: str | None


@dataclass(frozen=True)
class Operation(Node):
    """One update operation: its kind and what the kind needs."""

    kind: str
    delete: tuple[QuadPattern, ...] = ()
    insert: tuple[QuadPattern, ...] = ()
    pattern: Node | None = None
    source: str | None = None
    target: str | None = None
    silent: bool = False
    using: tuple[str, ...] = ()
    using_named: tuple[str, ...] = ()
    with_graph: str | None = None
    options: dict = field(default_factory=dict, compare=False)


EMPTY = Bgp(())


def children(node: Node) -> list[Node]:
    found = []
    for value in vars(node).values() if hasattr(node, "__dict__") else ():
        for x in value if isinstance(value, tuple) else (value,):
            if isinstance(x, Node):
                found.append(x)
            elif isinstance(x, tuple):
                found += [y for y in x if isinstance(y, Node)]
    return found


def expression_variables(node: Node | None) -> set[str]:
    """The variables an expression reads, those of EXISTS patterns included."""
    if node is None:
        return set()
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, Exists):
        return {v for v in variables(node.pattern) if not v.startswith("_:")}
    return set().union(*map(expression_variables, children(node)))


def _names(*terms: str | None) -> set[str]:
    found: set[str] = set()
    for t in terms:
        if t and t.startswith("?"):
            found.add(t[1:])
        elif t and t.startswith("<<("):
            from quadrille.terms import triple_parts

            found |= _names(*(triple_parts(t) or ()))
    return found


def variables(node: Node) -> set[str]:
    """In-scope variables of a pattern, hidden ones of blank nodes included."""
    if isinstance(node, Bgp):
        return set().union(*(_names(t.s, t.p, t.o) for t in node.triples))
    if isinstance(node, Path):
        return _names(node.s, node.o)
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, Extend):
        return variables(node.inner) | {node.name}
    if isinstance(node, Group):
        return {n for n, _ in node.keys} | {n for n, _ in node.aggregates}
    if isinstance(node, Project):
        return set(node.names)
    if isinstance(node, (Graph, Service)):
        return variables(node.inner) | _names(node.name)
    if isinstance(node, Minus):
        return variables(node.left)
    if isinstance(node, (Join, LeftJoin, Union)):
        return variables(node.left) | variables(node.right)
    if isinstance(node, (Filter, OrderBy, Distinct, Slice)):
        return variables(node.inner)
    return set()


def certain(node: Node) -> set[str]:
    """Variables that every solution binds.

    A group key is certain only if it is a variable that is certain in the input.
    """
    if isinstance(node, (Bgp, Path)):
        return variables(node)
    if isinstance(node, Values):
        return {n for i, n in enumerate(node.names) if all(r[i] is not None for r in node.rows)}
    if isinstance(node, Join):
        return certain(node.left) | certain(node.right)
    if isinstance(node, (LeftJoin, Minus)):
        return certain(node.left)
    if isinstance(node, Union):
        return certain(node.left) & certain(node.right)
    if isinstance(node, Graph):
        return certain(node.inner) | _names(node.name)
    if isinstance(node, Group):
        inner = certain(node.inner)
        return {n for n, e in node.keys if isinstance(e, Var) and e.name in inner} | {n for n, a in node.aggregates if a.name == "COUNT"}
    if isinstance(node, Project):
        return certain(node.inner) & set(node.names)
    if isinstance(node, (Filter, Extend, OrderBy, Distinct, Slice)):
        return certain(node.inner)
    return set()

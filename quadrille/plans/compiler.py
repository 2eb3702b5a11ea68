"""From algebra to DataFrames.

The plan is declarative: Catalyst orders, pushes down and prunes.  What the compiler
adds is what Catalyst cannot know: which variables are always bound, how columns hold
terms, and the fixpoints of paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import values as V
from quadrille.functions.scalar import Context, Expressions
from quadrille.functions.values import BOOLEAN, TERM, Rep, Value
from quadrille.operators import aggregates, joins
from quadrille.operators.frame import GRAPH, Frame, column_of
from quadrille.operators.paths import Relation, closure, relation
from quadrille.plans import algebra as A
from quadrille.plans.cut import cut
from quadrille.sources.quads import DEFAULT, ActiveGraph, Source

ServiceHandler = Callable[[str, A.Node, str], list[dict[str, str]]]


class ServiceRefused(RuntimeError):
    pass


@dataclass(frozen=True, eq=False)
class Rows(A.Values):
    """The values that outer rows have for some variables, as a pattern."""

    frame: Frame = None


@dataclass
class Compiler:
    spark: SparkSession
    source: Source
    context: Context = field(default_factory=Context)
    aggregates: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    service: ServiceHandler | None = None

    def compile(self, node: A.Node, graph: ActiveGraph = DEFAULT) -> Frame:
        return getattr(self, f"_{type(node).__name__.lower()}")(node, graph)

    # --- patterns of quads --------------------------------------------------------

    def _unit(self, graph: ActiveGraph) -> Frame:
        """The empty pattern: one solution, or one for each named graph."""
        if graph.kind == "any":
            return Frame(self.source.graphs().select(F.col("g").alias(column_of(GRAPH))), {GRAPH: TERM}, frozenset({GRAPH}))
        if graph.kind == "named":
            return Frame(self.source.graphs().where(F.col("g") == graph.name).select(F.lit(0).alias("_")), {})
        return Frame(self.spark.range(1).select(F.lit(0).alias("_")), {})

    def _bgp(self, node: A.Bgp, graph: ActiveGraph) -> Frame:
        if not node.triples:
            return self._unit(graph)
        frames = self.source.scan(tuple(dict.fromkeys(node.triples)), graph)
        return self._connected(frames)

    def _connected(self, frames: list[Frame]) -> Frame:
        """Joined so that each frame shares a variable with those before it, where one does."""
        left = frames.pop(0)
        while frames:
            at = next((i for i, f in enumerate(frames) if set(f.reps) & set(left.reps) - {GRAPH}), 0)
            left = joins.join(left, frames.pop(at))
        return left

    def _path(self, node: A.Path, graph: ActiveGraph) -> Frame:
        source = _PathSource(self.source, graph)
        path = node.path
        start = None if node.s.startswith("?") else node.s
        end = None if node.o.startswith("?") else node.o
        if isinstance(path, A.Repeat) and (start or end) and graph.kind != "any":
            step = relation(path.path, source).terms()
            if not start:  # walk back from the written end
                step = step.inverse()
            known = start or end
            seed = self.spark.createDataFrame([(known,)], "a string")
            found = closure(step, seed) if path.many else Relation(step.df.join(seed, "a", "left_semi").distinct())
            df = found.df
            if path.zero:
                df = df.unionByName(seed.select("a", F.col("a").alias("b"))).distinct()
            pairs = Relation(df) if start else Relation(df).inverse()
        else:
            pairs = relation(path, source)
            if isinstance(path, A.Repeat) and path.zero and (start or end):
                named = self.spark.createDataFrame([(t,) for t in {start, end} if t], "a string")
                if graph.kind == "any":
                    named = named.crossJoin(self.source.graphs())
                extra = named.select(*pairs.graph, "a", F.col("a").alias("b"))
                pairs = Relation(pairs.terms().df.unionByName(extra).distinct())
        df = pairs.df
        if start:
            df = df.where(V.to_term(F.col("a"), pairs.a) == start)
        if end:
            df = df.where(V.to_term(F.col("b"), pairs.b) == end)
        if node.s == node.o and not start:
            pairs = Relation(df, pairs.a, pairs.b).alike()
            df = pairs.df.where("a = b")
        columns: dict[str, tuple[str, Rep]] = {}
        if not start:
            columns[node.s[1:]] = ("a", pairs.a)
        if not end:
            columns.setdefault(node.o[1:], ("b", pairs.b))
        if graph.kind == "any":
            columns[GRAPH] = ("g", TERM)
        out = df.select(*[F.col(c).alias(column_of(n)) for n, (c, _) in columns.items()]) if columns else df.select(F.lit(0).alias("_"))
        return Frame(out, {n: r for n, (_, r) in columns.items()}, frozenset(columns))

    def _graph(self, node: A.Graph, graph: ActiveGraph) -> Frame:
        if not node.name.startswith("?"):
            return self._without_graph(self.compile(node.inner, ActiveGraph("named", node.name)), graph)
        name = node.name[1:]
        inner = self.compile(node.inner, ActiveGraph("any"))
        value = inner.value(GRAPH)
        if name in inner.reps:  # bound inside: it has to be the graph
            bound = inner.value(name)
            agree = bound.col.isNull() | V.same_term(bound, value) if name not in inner.certain else V.same_term(bound, value)
            inner = inner.where(agree)
        inner = inner.bind(name, value)
        kept = [n for n in inner.reps if n != GRAPH]
        out = inner.select(kept)
        return self._without_graph(Frame(out.df, out.reps, out.certain | {name}), graph)

    def _without_graph(self, frame: Frame, outer: ActiveGraph) -> Frame:
        """A GRAPH inside a GRAPH holds in each of the outer graphs."""
        return joins.join(frame, self._unit(outer)) if outer.kind == "any" else frame

    def _values(self, node: A.Values, graph: ActiveGraph) -> Frame:
        names = [column_of(n) for n in node.names]
        if not names:
            df = self.spark.range(len(node.rows)).select(F.lit(0).alias("_"))
            return joins.join(Frame(df, {}), self._unit(graph)) if graph.kind == "any" else Frame(df, {})
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], ", ".join(f"{n} string" for n in names))
        frame = Frame(df, dict.fromkeys(node.names, TERM), frozenset(A.certain(node)))
        return joins.join(frame, self._unit(graph)) if graph.kind == "any" else frame

    def _rows(self, node: Rows, graph: ActiveGraph) -> Frame:
        return joins.join(node.frame, self._unit(graph)) if graph.kind == "any" else node.frame

    # --- combinations -------------------------------------------------------------

    def _join(self, node: A.Join, graph: ActiveGraph) -> Frame:
        if isinstance(node.right, A.Service):
            return self._served(self.compile(node.left, graph), node.right)
        return joins.join(self.compile(node.left, graph), self.compile(node.right, graph))

    def _leftjoin(self, node: A.LeftJoin, graph: ActiveGraph) -> Frame:
        left, right = self.compile(node.left, graph), self.compile(node.right, graph)
        return joins.left_join(left, right, None if node.condition is None else self._test(node.condition, left, right))

    def _union(self, node: A.Union, graph: ActiveGraph) -> Frame:
        return joins.union(self.compile(node.left, graph), self.compile(node.right, graph))

    def _minus(self, node: A.Minus, graph: ActiveGraph) -> Frame:
        left, right = self.compile(node.left, graph), self.compile(node.right, graph)
        if graph.kind == "any":  # the graph alone is no shared variable
            shared = [n for n in right.reps if n in left.reps and n != GRAPH]
            if not shared:
                return left
        return joins.minus(left, right)

    # --- expressions ---------------------------------------------------------------

    def _expressions(self, values: dict[str, Value]) -> Expressions:
        return Expressions({n: v for n, v in values.items() if n != GRAPH}, self.context)

    def _prepared(self, e: A.Node, frame: Frame, graph: ActiveGraph) -> tuple[A.Node, Frame]:
        """An expression in which each EXISTS is a boolean column of the frame."""
        if isinstance(e, A.Exists):
            name = f".e{len(frame.reps)}"
            inner, condition = self._hoisted(e.pattern, frame)
            right = self.compile(inner, graph)
            if condition is not None:
                matched = joins.exists(frame, right, False, self._test(condition, frame, right))
                right = Frame(matched.df.distinct(), matched.reps, matched.certain)
                right = right.select(list(frame.reps))
            flag = joins.flagged(frame, right, column_of(name))
            frame = Frame(flag.df, {**flag.reps, name: BOOLEAN}, flag.certain | {name})
            found: A.Node = A.Var(name)
            return (A.Call("!", (found,)) if e.negated else found), frame
        if isinstance(e, A.Call):
            args = []
            for a in e.args:
                a, frame = self._prepared(a, frame, graph)
                args.append(a)
            return A.Call(e.name, tuple(args)), frame
        return e, frame

    def _test(self, condition: A.Node, left: Frame, right: Frame) -> Callable[[dict[str, Value]], Column]:
        """The condition of a join.

        Equality of terms is no plain equality, so Catalyst would compare all pairs: where each operand
        reads one side only, the operands' keys are compared as well, which are equal wherever they are.
        """
        sides = {n for n in left.reps if n in left.certain or n not in right.reps}, set(right.reps) - set(left.reps)

        def apart(e: A.Node) -> bool:
            if not (isinstance(e, A.Call) and e.name == "=") or _volatile(e):
                return False
            read = [A.expression_variables(x) for x in e.args]
            return all(read) and any(a <= sides[0] and b <= sides[1] for a, b in (read, read[::-1]))

        def test(values: dict[str, Value]) -> Column:
            made = self._expressions(values)
            parts = [made.condition(condition)]
            for e in filter(apart, _conjuncts(condition)):
                a, b = map(made.value, e.args)
                if not V.plainly_equal(a, b):
                    parts.append(V.equality_key(a) == V.equality_key(b))
            return reduce(lambda x, y: x & y, parts)

        return test

    def _hoisted(self, pattern: A.Node, frame: Frame) -> tuple[A.Node, A.Node | None]:
        """An EXISTS pattern that reads outer rows, with its own filter apart where that can be part of the join."""
        if isinstance(pattern, A.Filter) and not _has_exists(pattern.condition):
            inner = self._correlated(pattern.inner, frame)
            inside = A.certain(inner)
            if any(v not in inside and v in frame.reps for v in A.expression_variables(pattern.condition)):
                return inner, pattern.condition
            return replace(pattern, inner=inner), None
        return self._correlated(pattern, frame), None

    def _correlated(self, pattern: A.Node, frame: Frame) -> A.Node:
        """The pattern with the distinct outer values joined in wherever an expression reads a variable that only outer rows bind.

        Sub-queries have a scope of their own and stay as they are.
        """

        def known(inner: A.Node, *expressions: A.Node | None) -> A.Node:
            read = set().union(*map(_mentioned, [e for e in expressions if e is not None]))
            names = sorted((read & set(frame.reps)) - A.certain(inner) - {GRAPH})
            if not names:
                return inner
            rows = frame.select(names)
            return A.Join(Rows(tuple(names), (), Frame(rows.df.distinct(), rows.reps, rows.certain)), inner)

        if isinstance(pattern, A.Filter):
            return replace(pattern, inner=known(self._correlated(pattern.inner, frame), pattern.condition))
        if isinstance(pattern, A.Extend):
            return replace(pattern, inner=known(self._correlated(pattern.inner, frame), pattern.value))
        if isinstance(pattern, A.LeftJoin):
            return replace(pattern, left=known(self._correlated(pattern.left, frame), pattern.condition), right=self._correlated(pattern.right, frame))
        if isinstance(pattern, (A.Join, A.Union, A.Minus)):
            return replace(pattern, left=self._correlated(pattern.left, frame), right=self._correlated(pattern.right, frame))
        if isinstance(pattern, A.Graph):
            return replace(pattern, inner=self._correlated(pattern.inner, frame))
        return pattern

    def _filter(self, node: A.Filter, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        names = list(frame.reps)
        for part in _conjuncts(node.condition):
            if isinstance(part, A.Exists):
                inner, condition = self._hoisted(part.pattern, frame)
                right = self.compile(inner, graph)
                frame = joins.exists(frame, right, part.negated, None if condition is None else self._test(condition, frame, right))
                continue
            part, frame = self._prepared(part, frame, graph)
            frame, values = frame.laned(_read(part))
            frame = frame.where(self._expressions(values).condition(part))
        return frame if len(frame.df.columns) == len(names) else frame.select(names)

    def _extend(self, node: A.Extend, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        names = list(frame.reps)
        value, frame = self._prepared(node.value, frame, graph)
        frame, values = frame.laned(_read(value))
        made = self._expressions(values).value(value)
        out = frame.bind(node.name, made)
        if _volatile(value):
            out = Frame(cut(out.df), out.reps, out.certain)
        sure = isinstance(value, A.Const) or isinstance(value, A.Var) and value.name in frame.certain
        out = Frame(out.df, out.reps, out.certain | {node.name} if sure else out.certain)
        return out.select([*names, node.name])

    def _group(self, node: A.Group, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        read = set().union(*(_read(e) for _, e in node.keys), *(_read(a.arg) for _, a in node.aggregates if a.arg is not None and a.name not in ("COUNT", "SAMPLE")))
        frame, values = frame.laned(read)
        return aggregates.group(frame, node, self._expressions(values), self.aggregates)

    # --- modifiers -----------------------------------------------------------------

    def _orderby(self, node: A.OrderBy, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        names = list(frame.reps)
        keys = []
        for e, descending in node.keys:
            e, frame = self._prepared(e, frame, graph)
            frame, values = frame.laned(_read(e) | ({e.name} if isinstance(e, A.Var) else set()))
            key = V.sort_key(self._expressions(values).value(e))
            keys.append(key.desc_nulls_last() if descending else key.asc_nulls_first())
        out = Frame(frame.df.orderBy(*keys), frame.reps, frame.certain)
        return out if len(out.df.columns) == len(names) else out.select(names)

    def _project(self, node: A.Project, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        return frame.select([*node.names, *([GRAPH] if graph.kind == "any" else [])])

    def _distinct(self, node: A.Distinct, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        return Frame(frame.df.distinct(), frame.reps, frame.certain)

    def _slice(self, node: A.Slice, graph: ActiveGraph) -> Frame:
        frame = self.compile(node.inner, graph)
        df = frame.df.offset(node.offset) if node.offset else frame.df
        return Frame(df if node.limit is None else df.limit(node.limit), frame.reps, frame.certain)

    # --- federation ----------------------------------------------------------------

    def _service(self, node: A.Service, graph: ActiveGraph) -> Frame:
        return self._served(self._unit(DEFAULT), node)

    def _served(self, left: Frame, node: A.Service) -> Frame:
        """One call of the handler for each endpoint; without a handler the call is refused."""
        try:
            if node.name.startswith("?"):
                name = node.name[1:]
                ends = [r[0] for r in left.as_terms({name}).df.select(column_of(name)).distinct().collect()] if name in left.reps else []
            else:
                ends = [node.name]
            names = sorted(n for n in A.variables(node.inner) if not n.startswith(("_:", ".")))
            rows = []
            for end in ends:
                if self.service is None:
                    raise ServiceRefused(f"no service handler for {end}")
                found = self.service(end, node.inner, node.text)
                rows += [(*[r.get(n) for n in names], *([end] if node.name.startswith("?") else [])) for r in found]
        except Exception:
            if node.silent:
                return left
            raise
        names += [node.name[1:]] if node.name.startswith("?") else []
        return joins.join(left, self._values(A.Values(tuple(names), tuple(rows)), DEFAULT))


def _conjuncts(e: A.Node) -> list[A.Node]:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, A.Call) and e.name == "&&" else [e]


def _has_exists(e: A.Node) -> bool:
    return isinstance(e, A.Exists) or any(map(_has_exists, A.children(e)))


def _mentioned(node: A.Node) -> set[str]:
    """All variables that an expression reads, those in the expressions of its EXISTS patterns included."""
    if isinstance(node, A.Var):
        return {node.name}
    return {v for v in A.variables(node) if not v.startswith("_:")}.union(*map(_mentioned, A.children(node)))


def _read(e: A.Node) -> set[str]:
    """Variables whose parts an expression needs, not only the term."""
    if isinstance(e, A.Call):
        if e.name in ("BOUND", "SAMETERM", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISTRIPLE", "COALESCE", "IF") and all(isinstance(a, (A.Var, A.Const)) for a in e.args):
            return {e.args[0].name} if e.name == "IF" and isinstance(e.args[0], A.Var) else set()
        return set().union(*({a.name} if isinstance(a, A.Var) else _read(a) for a in e.args))
    return {e.name} if isinstance(e, A.Var) else set()


def _volatile(e: A.Node) -> bool:
    """Whether a value is made anew at each evaluation, so that it has to be stored once."""
    return isinstance(e, A.Call) and (e.name in ("RAND", "UUID", "STRUUID", "BNODE") or any(map(_volatile, e.args)))


@dataclass
class _PathSource:
    source: Source
    graph: ActiveGraph

    def edges(self, iri: str) -> Relation:
        return self.source.edges(iri, self.graph)

    def all_edges(self) -> DataFrame:
        df = self.source.quads(self.graph)
        return df.select(*[c for c in df.columns if c == "g"], F.col("s").alias("a"), "p", F.col("o").alias("b"))

    def nodes(self) -> DataFrame:
        df = self.source.quads(self.graph)
        graph = [c for c in df.columns if c == "g"]
        return reduce(DataFrame.unionByName, [df.select(*graph, F.col(c).alias("a")) for c in "so"]).distinct()

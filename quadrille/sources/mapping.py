"""Relational tables as quads, without making the quads.

A row of table t with key k is the subject ``<urn:t:t/k>``, of type ``<urn:t:T>``; each
column c is the predicate ``<urn:c:c>``.  Foreign keys become the IRI of the row they
name; other columns become literals of their type.  NULL gives no triple.

Triples with one subject and constant predicates of one table are one scan of the
columns they name: keys and values keep their native types, so filters and projections
reach the files, joins are on keys, and no term string is built before the result.  Only
a variable predicate unpivots.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.values import BOOLEAN, DATETIME, DOUBLE, INTEGER, STRING, TERM, Rep, to_term
from quadrille.operators.frame import GRAPH, Frame, column_of
from quadrille.operators.paths import Relation
from quadrille.plans import algebra as A
from quadrille.sources.quads import ActiveGraph, Source, match
from quadrille.terms import TYPE, XSD, parse_literal


@dataclass(frozen=True)
class Table:
    """``key`` is an expression; ``links`` maps columns to the tables they refer to; ``graph`` names a column whose value is the rows' named graph."""

    name: str
    df: DataFrame
    key: str
    links: dict[str, str] = field(default_factory=dict)
    graph: str | None = None
    skip: tuple[str, ...] = ()

    @property
    def type(self) -> str:
        return f"<urn:t:{self.name[:1].upper()}{self.name[1:]}>"

    def subject(self) -> Rep:
        return Rep("iri", f"urn:t:{self.name}/")

    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.skip]

    def value(self, column: str) -> tuple[Column, Rep]:
        kind = self.df.schema[column].dataType
        col = F.col(column)
        if column in self.links:
            return col.cast("bigint") if isinstance(kind, T.IntegralType) else col, Rep("iri", f"urn:t:{self.links[column]}/")
        if isinstance(kind, T.IntegralType):
            return col.cast("bigint"), INTEGER
        if isinstance(kind, T.FractionalType):
            return col.cast("double"), DOUBLE
        if isinstance(kind, T.BooleanType):
            return col, BOOLEAN
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return col.cast("timestamp_ntz"), DATETIME
        return col.cast("string"), STRING

    def key_column(self) -> Column:
        return F.expr(self.key)


def _constant(col: Column, rep: Rep, term: str) -> Column:
    """Whether a native column is a term."""
    if rep.kind == "iri":
        inside = term.startswith(f"<{rep.prefix}")
        return col.cast("string") == term[len(rep.prefix) + 1 : -1] if inside else F.lit(False)
    lit = parse_literal(term) if term.startswith('"') else None
    if lit is None:
        return F.lit(False)
    if rep.kind == "string":
        return col == lit.lex if lit.datatype == f"{XSD}string" else F.lit(False)
    return to_term(col, rep) == term if lit.datatype == f"{XSD}{rep.kind}" else F.lit(False)


@dataclass(frozen=True)
class MappedTables(Source):
    tables: dict[str, Table]
    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None

    def with_dataset(self, default: tuple[str, ...], named: tuple[str, ...]) -> MappedTables:
        return replace(self, default=default, named=named)

    def _owner(self, predicate: str) -> tuple[Table, str] | None:
        if predicate.startswith("<urn:c:"):
            column = predicate[7:-1]
            for t in self.tables.values():
                if column in t.columns():
                    return t, column
        return None

    def _rows(self, table: Table, graph: ActiveGraph) -> DataFrame | None:
        """The table's rows in the active graph; None if it has none."""
        prefix = "<urn:g:"
        if graph.kind == "default":
            if self.default is None:
                return table.df if table.graph is None else None
            names = [g[len(prefix) : -1] for g in self.default if g.startswith(prefix)]
            return table.df.where(F.col(table.graph).isin(names)) if table.graph else None
        if table.graph is None:
            return None
        rows = table.df.where(F.col(table.graph).isNotNull())
        if self.named is not None:
            rows = rows.where(F.col(table.graph).isin([g[len(prefix) : -1] for g in self.named if g.startswith(prefix)]))
        if graph.kind == "any":
            return rows
        return rows.where(F.col(table.graph) == graph.name[len(prefix) : -1]) if graph.name.startswith(prefix) else None

    def _star(self, table: Table, subject: str, parts: list[tuple[str, str]], graph: ActiveGraph) -> Frame | None:
        """One scan of a table for triples of one subject; parts are (column or '' for the type, object)."""
        rows = self._rows(table, graph)
        if rows is None:
            return None
        columns: dict[str, tuple[Column, Rep]] = {}
        tests: list[Column] = []

        def bind(pattern: str, col: Column, rep: Rep) -> None:
            if not pattern.startswith("?"):
                tests.append(_constant(col, rep, pattern))
            elif pattern[1:] in columns:
                other, its = columns[pattern[1:]]
                tests.append(other == col if its == rep else to_term(other, its) == to_term(col, rep))
            else:
                columns[pattern[1:]] = (col, rep)

        bind(subject, table.key_column(), table.subject())
        for column, o in parts:
            if not column:
                if o.startswith("?"):
                    columns[o[1:]] = (F.lit(table.type), TERM)
                elif o != table.type:
                    tests.append(F.lit(False))
                continue
            col, rep = table.value(column)
            tests.append(col.isNotNull())
            bind(o, col, rep)
        if graph.kind == "any":
            columns[GRAPH] = (F.col(table.graph), Rep("iri", "urn:g:"))
        for test in tests:
            rows = rows.where(test)
        out = rows.select(*[c.alias(column_of(n)) for n, (c, _) in columns.items()]) if columns else rows.select(F.lit(0).alias("_"))
        return Frame(out, {n: r for n, (_, r) in columns.items()}, frozenset(columns))

    def scan(self, triples: tuple[A.Triple, ...], graph: ActiveGraph) -> list[Frame]:
        stars: dict[tuple[str, str], list[tuple[str, str]]] = {}
        types: list[A.Triple] = []
        rest: list[A.Triple] = []
        for t in triples:
            owner = None if t.p.startswith("?") else self._owner(t.p)
            if owner:
                stars.setdefault((owner[0].name, t.s), []).append((owner[1], t.o))
            elif t.p == TYPE and not t.o.startswith("?"):
                types.append(t)
            else:
                rest.append(t)
        for t in types:
            table = next((x for x in self.tables.values() if x.type == t.o), None)
            if table is None:
                rest.append(t)
            else:
                stars.setdefault((table.name, t.s), []).append(("", t.o))
        found = []
        for (name, s), parts in stars.items():
            frame = self._star(self.tables[name], s, parts, graph)
            if frame is None:
                rest += [A.Triple(s, f"<urn:c:{c}>" if c else TYPE, o) for c, o in parts]
            else:
                found.append(frame)
        return found + [match(self._narrowed(t, graph), t) for t in rest]

    def _narrowed(self, triple: A.Triple, graph: ActiveGraph) -> DataFrame:
        """The quads that a pattern may match: the table of a constant subject, else all."""
        if triple.s.startswith("<urn:t:"):
            name = triple.s[7:].split("/")[0]
            return self._unpivoted([t for t in self.tables.values() if t.name == name], graph)
        return self.quads(graph)

    def _unpivoted(self, tables: list[Table], graph: ActiveGraph) -> DataFrame:
        parts = []
        for table in tables:
            rows = self._rows(table, graph)
            if rows is None:
                continue
            pairs = [F.struct(F.lit(TYPE).alias("p"), F.lit(table.type).alias("o"))]
            for column in table.columns():
                col, rep = table.value(column)
                pairs.append(F.struct(F.lit(f"<urn:c:{column}>").alias("p"), to_term(col, rep).alias("o")))
            g = [to_term(F.col(table.graph), Rep("iri", "urn:g:")).alias("g")] if graph.kind == "any" else []
            s = to_term(table.key_column(), table.subject()).alias("s")
            parts.append(rows.select(s, *g, F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o", *(["g"] if g else [])).where("s is not null and o is not null"))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        spark = next(iter(self.tables.values())).df.sparkSession
        return spark.createDataFrame([], "s string, p string, o string" + (", g string" if graph.kind == "any" else ""))

    def quads(self, graph: ActiveGraph) -> DataFrame:
        return self._unpivoted(list(self.tables.values()), graph)

    def all_quads(self) -> DataFrame:
        """(s, p, o, g) of the default and the named graphs."""
        default = self.quads(ActiveGraph()).withColumn("g", F.lit(None).cast("string"))
        return default.unionByName(self.quads(ActiveGraph("any")))

    def graphs(self) -> DataFrame:
        found = [self._rows(t, ActiveGraph("any")) for t in self.tables.values() if t.graph]
        names = [r.select(to_term(F.col(t.graph), Rep("iri", "urn:g:")).alias("g")) for r, t in zip(found, [t for t in self.tables.values() if t.graph])]
        if names:
            return reduce(DataFrame.unionByName, names).distinct()
        return next(iter(self.tables.values())).df.sparkSession.createDataFrame([], "g string")

    def edges(self, predicate: str, graph: ActiveGraph) -> Relation:
        owner = self._owner(predicate)
        rows = self._rows(owner[0], graph) if owner else None
        if rows is None:
            df = self.quads(graph).where(F.col("p") == predicate)
            return Relation(df.select(*[c for c in df.columns if c == "g"], F.col("s").alias("a"), F.col("o").alias("b")))
        table, column = owner
        col, rep = table.value(column)
        g = [to_term(F.col(table.graph), Rep("iri", "urn:g:")).alias("g")] if graph.kind == "any" else []
        return Relation(rows.where(col.isNotNull()).select(*g, table.key_column().alias("a"), col.alias("b")), table.subject(), rep)

"""Datasets of quads, and what the compiler asks of any source."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.scalar import triple_part
from quadrille.functions.values import TERM
from quadrille.operators.frame import GRAPH, Frame, column_of
from quadrille.operators.paths import Relation
from quadrille.plans import algebra as A
from quadrille.terms import triple_parts

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "spog"])


@dataclass(frozen=True)
class ActiveGraph:
    """default, one named graph, or ``any`` named graph, whose name then is the hidden variable."""

    kind: str = "default"
    name: str = ""


DEFAULT = ActiveGraph()


class Source:
    """A dataset as the compiler sees it."""

    def scan(self, triples: tuple[A.Triple, ...], graph: ActiveGraph) -> list[Frame]:
        """Frames whose join is the conjunction of the triples."""
        raise NotImplementedError

    def edges(self, predicate: str, graph: ActiveGraph) -> Relation:
        raise NotImplementedError

    def quads(self, graph: ActiveGraph) -> DataFrame:
        """(s, p, o) terms of the active graph, with g under ``any``."""
        raise NotImplementedError

    def graphs(self) -> DataFrame:
        """(g), the names of the named graphs."""
        raise NotImplementedError

    def with_dataset(self, default: tuple[str, ...], named: tuple[str, ...]) -> Source:
        raise NotImplementedError


def match(df: DataFrame, triple: A.Triple) -> Frame:
    """The solutions of one triple pattern over (s, p, o[, g]) term columns."""
    columns: dict[str, Column] = {}

    def bind(pattern: str, value: Column) -> Column | None:
        if pattern.startswith("?"):
            name = pattern[1:]
            if name in columns:
                return columns[name] == value
            columns[name] = value
            return None
        if pattern.startswith("<<(") and "?" in pattern:
            tests = [value.startswith("<<(")]
            for i, part in enumerate(triple_parts(pattern)):
                test = bind(part, triple_part(value, i))
                if test is not None:
                    tests.append(test)
            return reduce(lambda a, b: a & b, tests)
        return value == pattern

    for pattern, c in ((triple.p, "p"), (triple.s, "s"), (triple.o, "o")):
        test = bind(pattern, F.col(c))
        if test is not None:
            df = df.where(test)
    if "g" in df.columns:
        columns[GRAPH] = F.col("g")
    out = df.select(*[v.alias(column_of(n)) for n, v in columns.items()]) if columns else df.select(F.lit(0).alias("_"))
    return Frame(out, dict.fromkeys(columns, TERM), frozenset(columns))


@dataclass(frozen=True)
class Dataset(Source):
    """A frame of (s, p, o, g) terms without repeated rows; g is NULL in the default graph.

    ``default`` and ``named`` choose the graphs of a query's dataset clause; None is the
    dataset's own.
    """

    df: DataFrame
    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple]) -> Dataset:
        padded = [(*r, None)[:4] for r in rows]
        return Dataset(spark.createDataFrame(padded, SCHEMA).distinct())

    def with_dataset(self, default: tuple[str, ...], named: tuple[str, ...]) -> Dataset:
        return replace(self, default=default, named=named)

    def quads(self, graph: ActiveGraph) -> DataFrame:
        if graph.kind == "default":
            if self.default is None:
                return self.df.where("g is null").select("s", "p", "o")
            found = self.df.where(F.col("g").isin(list(self.default))).select("s", "p", "o")
            return found if len(self.default) < 2 else found.distinct()
        named = self.df.where("g is not null") if self.named is None else self.df.where(F.col("g").isin(list(self.named)))
        return named if graph.kind == "any" else named.where(F.col("g") == graph.name).select("s", "p", "o")

    def graphs(self) -> DataFrame:
        return self.quads(ActiveGraph("any")).select("g").distinct()

    def scan(self, triples: tuple[A.Triple, ...], graph: ActiveGraph) -> list[Frame]:
        return [match(self.quads(graph), t) for t in triples]

    def edges(self, predicate: str, graph: ActiveGraph) -> Relation:
        df = self.quads(graph).where(F.col("p") == predicate)
        return Relation(df.select(*[c for c in df.columns if c == "g"], F.col("s").alias("a"), F.col("o").alias("b")))

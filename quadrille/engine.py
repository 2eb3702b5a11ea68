"""Queries over a source of quads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.scalar import Context
from quadrille.functions.values import TERM, to_term
from quadrille.operators.frame import Frame, column_of
from quadrille.plans import algebra as A
from quadrille.plans.compiler import Compiler, ServiceHandler
from quadrille.plans.cut import cut
from quadrille.plans.parser import parse_query
from quadrille.plans.rewrite import optimise
from quadrille.sources.quads import DEFAULT, Dataset, Source
from quadrille.terms import triple_parts


@dataclass
class Engine:
    """Evaluates SPARQL text over a source.

    ``functions`` maps IRIs to functions of term columns, ``aggregates`` IRIs to functions
    of a term column that aggregate; ``service`` answers SERVICE calls, which are refused
    without it.
    """

    spark: SparkSession
    source: Source
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    aggregates: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    service: ServiceHandler | None = None
    now: datetime | None = None
    seed: int | None = None
    rewrite: bool = True

    def _compiler(self, query: A.Query) -> Compiler:
        source = self.source
        if query.default_graphs is not None:
            source = source.with_dataset(query.default_graphs, query.named_graphs or ())
        return Compiler(self.spark, source, Context(query.base, self.now, self.seed, self.functions), self.aggregates, self.service)

    def parse(self, text: str) -> A.Query:
        return parse_query(text, custom_aggregates=frozenset(f"<{i}>" for i in self.aggregates))

    def frame(self, text: str) -> tuple[A.Query, Frame]:
        query = self.parse(text)
        pattern = optimise(query.pattern) if self.rewrite else query.pattern
        compiler = self._compiler(query)
        compiler.aggregates = {f"<{i}>": f for i, f in self.aggregates.items()}
        return query, compiler.compile(pattern)

    def select(self, text: str) -> DataFrame:
        """A SELECT query's solutions: a column of term strings for each variable."""
        query, frame = self.frame(text)
        if query.form != "SELECT":
            raise ValueError(f"{query.form} is not SELECT")
        return frame.df.select(*[to_term(frame.col(n), frame.reps[n]).alias(n) for n in query.names])

    def table(self, text: str) -> DataFrame:
        """A SELECT query's solutions as native columns: IRIs without brackets, numbers, strings, times."""
        query, frame = self.frame(text)

        def native(n: str) -> Column:
            rep = frame.reps[n]
            return F.concat(F.lit(rep.prefix), frame.col(n).cast("string")) if rep.kind == "iri" else frame.col(n)

        return frame.df.select(*[native(n).alias(n) for n in query.names])

    def ask(self, text: str) -> bool:
        return not self.frame(text)[1].df.limit(1).isEmpty()

    def construct(self, text: str) -> DataFrame:
        """A CONSTRUCT query's triples (s, p, o), a set."""
        query, frame = self.frame(text)
        return instantiate(frame, [A.QuadPattern(t.s, t.p, t.o, None) for t in query.template]).select("s", "p", "o")

    def describe(self, text: str) -> DataFrame:
        """Triples of the default graph about the resources, closed over blank objects."""
        query, frame = self.frame(text)
        constants = [(d,) for d in query.described if not d.startswith("?")]
        names = [d[1:] for d in query.described if d.startswith("?") and d[1:] in frame.reps]
        frame = frame.as_terms(set(names))
        parts = [frame.df.select(frame.col(n).alias("s")) for n in names]
        if constants:
            parts.append(self.spark.createDataFrame(constants, "s string"))
        triples = self._compiler(query).source.quads(DEFAULT)
        if not parts:
            return triples.limit(0)
        return closure_of_nodes(triples, reduce(DataFrame.unionByName, parts).where("s is not null").distinct())

    def query(self, text: str):
        """A frame for SELECT, CONSTRUCT and DESCRIBE; a boolean for ASK."""
        form = self.parse(text).form
        return getattr(self, form.lower())(text)


def closure_of_nodes(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The triples whose subject is one of ``nodes`` (s) or a blank node that such a triple leads to."""
    seen = cut(nodes)
    fresh = seen
    while not fresh.isEmpty():
        blank = triples.join(fresh, "s", "left_semi").where("startswith(o, '_:')").select(F.col("o").alias("s")).distinct()
        fresh = cut(blank.join(seen, "s", "left_anti"))
        seen = cut(seen.unionByName(fresh))
    return triples.join(seen, "s", "left_semi").distinct()


def instantiate(frame: Frame, template: list[A.QuadPattern], default_graph: str | None = None) -> DataFrame:
    """The quads of a template, a set; invalid ones are left out.

    A quad is invalid if a part is unbound, its subject is a literal or triple term, its
    predicate no IRI, or its graph no IRI or blank node.  Blank nodes are fresh for each
    solution.
    """
    names = sorted(set().union(*[set(_variables(x)) for q in template for x in (q.s, q.p, q.o, q.g or "")]))
    frame = frame.select([n for n in names if n in frame.reps]).as_terms(set(frame.reps))
    df = frame.df
    blanks = any(n.startswith("_:") for n in names)
    if blanks:
        df = cut(df.withColumn("_row", F.monotonically_increasing_id()))

    def part(x: str | None) -> Column:
        if x is None:
            return F.lit(default_graph).cast("string")
        if x.startswith("?_:"):
            return F.concat(F.lit(f"_:q{_unique(df)}x"), F.col("_row").cast("string"), F.lit(f"x{x[3:]}"))
        if x.startswith("?"):
            return F.col(column_of(x[1:])) if x[1:] in frame.reps else F.lit(None).cast("string")
        if x.startswith("<<("):
            s, p, o = triple_parts(x)
            return F.concat(F.lit("<<( "), part(s), F.lit(" "), part(p), F.lit(" "), part(o), F.lit(" )>>"))
        return F.lit(x)

    rows = F.array(*[F.struct(part(q.s).alias("s"), part(q.p).alias("p"), part(q.o).alias("o"), part(q.g).alias("g"), F.lit(q.g is not None).alias("named")) for q in template])
    out = df.select(F.explode(rows).alias("q")).select("q.*")
    is_iri = lambda c: F.col(c).startswith("<") & ~F.col(c).startswith("<<(")
    good = (is_iri("s") | F.col("s").startswith("_:")) & is_iri("p") & F.col("o").isNotNull() & (~F.col("named") | is_iri("g") | F.col("g").startswith("_:"))
    return out.where(F.coalesce(good, F.lit(False))).select("s", "p", "o", "g").distinct()


def _unique(df: DataFrame) -> str:
    return format(abs(hash(df)) % (1 << 32), "x")


def _variables(x: str) -> list[str]:
    if x.startswith("<<("):
        return [v for p in triple_parts(x) for v in _variables(p)]
    return [x[1:]] if x.startswith("?") else []


__all__ = ["Dataset", "Engine", "TERM", "instantiate"]

"""Property paths: relations of node pairs, closed by semi-naive iteration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.values import TERM, Rep, to_term
from quadrille.plans import algebra as A
from quadrille.plans.cut import cut


@dataclass(frozen=True)
class Relation:
    """Pairs (a, b), and g where each graph stands for itself."""

    df: DataFrame
    a: Rep = TERM
    b: Rep = TERM

    @property
    def graph(self) -> list[str]:
        return ["g"] if "g" in self.df.columns else []

    def terms(self) -> Relation:
        if self.a == self.b == TERM:
            return self
        return Relation(self.df.select(*self.graph, to_term(F.col("a"), self.a).alias("a"), to_term(F.col("b"), self.b).alias("b")))

    def alike(self) -> Relation:
        """Both ends in one representation."""
        return self if self.a == self.b else self.terms()

    def inverse(self) -> Relation:
        return Relation(self.df.select(*self.graph, F.col("b").alias("a"), F.col("a").alias("b")), self.b, self.a)


def _union(x: Relation, y: Relation) -> Relation:
    if (x.a, x.b) != (y.a, y.b):
        x, y = x.terms(), y.terms()
    return Relation(x.df.unionByName(y.df), x.a, x.b)


def relation(path: A.Node, source) -> Relation:
    """The pairs of a path; a multiset for links, sequences and alternatives, else a set.

    ``source`` gives ``edges(iri)``, ``all_edges()`` as (a, p, b[, g]) of terms, and ``nodes()`` as (a[, g]).
    """
    if isinstance(path, A.Link):
        return source.edges(path.iri)
    if isinstance(path, A.Inverse):
        return relation(path.path, source).inverse()
    if isinstance(path, A.Alt):
        return _union(relation(path.left, source), relation(path.right, source))
    if isinstance(path, A.Seq):
        x, y = relation(path.left, source), relation(path.right, source)
        if x.b != y.a:
            x, y = x.terms(), y.terms()
        left = x.df.withColumnRenamed("b", "m")
        right = y.df.withColumnRenamed("a", "m")
        return Relation(left.join(right, [*x.graph, "m"]).select(*x.graph, "a", "b"), x.a, y.b)
    if isinstance(path, A.Negated):
        return _negated(path, source)
    if isinstance(path, A.Repeat):
        step = relation(path.path, source).alike()
        found = closure(step) if path.many else Relation(step.df.distinct(), step.a, step.b)
        return _with_identity(source, found) if path.zero else found
    raise TypeError(type(path).__name__)


def _with_identity(source, found: Relation) -> Relation:
    nodes = source.nodes()
    same = Relation(nodes.select(*[c for c in nodes.columns if c == "g"], "a", F.col("a").alias("b")))
    both = _union(same, found.terms())
    return Relation(both.df.distinct())


def _negated(path: A.Negated, source) -> Relation:
    edges = source.all_edges()
    graph = [c for c in edges.columns if c == "g"]
    halves = []
    if path.forward or not path.backward:
        halves.append(edges.where(~F.col("p").isin(list(path.forward))).select(*graph, "a", "b").distinct())
    if path.backward:
        halves.append(edges.where(~F.col("p").isin(list(path.backward))).select(*graph, F.col("b").alias("a"), F.col("a").alias("b")).distinct())
    return Relation(reduce(DataFrame.unionByName, halves))


def closure(step: Relation, start: DataFrame | None = None, most_rounds: int = 10_000) -> Relation:
    """One or more steps, as a set of pairs.

    ``start`` (a) limits the first ends.  Each round joins only the pairs that the round
    before found, and keeps what is new; it ends when nothing is.
    """
    graph = step.graph
    edges = cut(step.df.select(*graph, "a", "b").where("a is not null and b is not null").distinct())
    found = edges if start is None else edges.join(start.select("a").distinct(), "a", "left_semi").select(*graph, "a", "b")
    found = cut(found)
    rounds = [found]
    frontier = found
    hop = edges.select(*graph, F.col("a").alias("b"), F.col("b").alias("c"))
    for _ in range(most_rounds):
        seen = reduce(DataFrame.unionByName, rounds)
        fresh = frontier.join(hop, [*graph, "b"]).select(*graph, "a", F.col("c").alias("b")).distinct()
        fresh = cut(fresh.join(seen, [*graph, "a", "b"], "left_anti"))
        if fresh.isEmpty():
            return Relation(seen, step.a, step.b)
        rounds.append(fresh)
        if len(rounds) > 8:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
        frontier = fresh
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")

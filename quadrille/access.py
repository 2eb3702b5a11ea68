"""What a caller may see and write: graph scopes, row scopes by data subject, and classification."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.cut import cut
from quadrille.sources.quads import Dataset


@dataclass(frozen=True)
class GraphScope:
    """Graphs by name, by prefix of the IRI, and the default graph."""

    names: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    default: bool = False

    def holds(self) -> Column:
        tests = [F.col("g").isin(list(self.names))] if self.names else []
        tests += [F.col("g").startswith(f"<{p}") for p in self.prefixes]
        named = reduce(lambda a, b: a | b, tests, F.lit(False))
        return F.when(F.col("g").isNull(), self.default).otherwise(named)

    def of(self, source: Dataset) -> Dataset:
        return replace(source, df=source.df.where(self.holds()))


def classify(quads: DataFrame, roots: DataFrame, links: list[str]) -> DataFrame:
    """(node, subject): the data subjects of every node, by walking link predicates backwards from ``roots`` (node, subject).

    A node that links to a classified node has its subjects too; semi-naive until nothing is new.
    """
    steps = cut(quads.where(F.col("p").isin(links)).select(F.col("s").alias("from"), F.col("o").alias("node")).distinct())
    found = cut(roots.select("node", "subject").distinct())
    fresh = found
    while not fresh.isEmpty():
        reached = fresh.join(steps, "node").select(F.col("from").alias("node"), "subject").distinct()
        fresh = cut(reached.join(found, ["node", "subject"], "left_anti"))
        found = cut(found.unionByName(fresh))
    return found


def row_scope(quads: DataFrame, classes: DataFrame, allowed: list[str], public_links: list[str]) -> DataFrame:
    """The quads whose subject's data subjects, and whose object's unless the predicate is a public link, are all allowed.

    A node without data subjects hides nothing.
    """
    hidden = classes.where(~F.col("subject").isin(allowed)).select("node").distinct()
    shown = quads.join(hidden.withColumnRenamed("node", "s"), "s", "left_anti")
    by_object = hidden.withColumnRenamed("node", "o")
    public = F.col("p").isin(public_links)
    return shown.where(public).unionByName(shown.where(~public).join(by_object, "o", "left_anti").select(*shown.columns)).select(*quads.columns)


def subject_access(quads: DataFrame, classes: DataFrame, subject: str) -> DataFrame:
    """All quads about a data subject."""
    nodes = classes.where(F.col("subject") == subject).select(F.col("node").alias("s")).distinct()
    return quads.join(nodes, "s", "left_semi").select(*quads.columns)


def may_write(delta: DataFrame, classes: DataFrame, allowed: list[str]) -> DataFrame:
    """The changes that a row-scoped caller may not make."""
    hidden = classes.where(~F.col("subject").isin(allowed)).select(F.col("node").alias("s")).distinct()
    return delta.join(hidden, "s", "left_semi").select(*delta.columns)

"""SPARQL Update: one request is one commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.engine import instantiate
from quadrille.functions.scalar import Context
from quadrille.operators.frame import Frame
from quadrille.plans import algebra as A
from quadrille.plans.compiler import Compiler
from quadrille.plans.cut import cut
from quadrille.plans.parser import parse_update
from quadrille.plans.rewrite import optimise
from quadrille.sources.quads import DEFAULT, Dataset
from quadrille.store import QUAD, Outcome, Store, _within, _without, overlay


class UpdateError(RuntimeError):
    pass


@dataclass
class Updater:
    """Runs requests against a store; ``load`` reads the document of an IRI as quads, and is refused without one."""

    store: Store
    load: Callable[[str], DataFrame] | None = None

    def run(self, text: str, **options) -> Outcome:
        """Each operation sees what those before it did; the request's whole effect is committed at the head it began with."""
        position = self.store.head()
        base = self.store.quads(position)
        state = base
        touched: DataFrame | None = None
        for operation in parse_update(text):
            added, removed = self._effect(operation, state)
            added, removed = cut(added.select(*QUAD).distinct()), cut(removed.select(*QUAD).distinct())
            state = cut(overlay(state, added, removed))
            both = added.unionByName(removed)
            touched = both if touched is None else touched.unionByName(both)
        if touched is None:
            return Outcome("no change", position)
        touched = touched.distinct()
        plus, minus = _within(touched, state), _without(touched, state)
        operations = plus.withColumn("op", F.lit("+")).unionByName(minus.withColumn("op", F.lit("-")))
        options.setdefault("expected", position)
        return self.store.apply(operations, **options)

    def _none(self, state: DataFrame) -> DataFrame:
        return state.limit(0)

    def _constant(self, quads: tuple[A.QuadPattern, ...], state: DataFrame) -> DataFrame:
        unit = Frame(state.sparkSession.range(1).select(F.lit(0).alias("_")), {})
        return instantiate(unit, list(quads)) if quads else self._none(state)

    def _effect(self, op: A.Operation, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Quads to assert and to retract; a quad in both is asserted."""
        if op.kind == "INSERT DATA":
            return self._constant(op.insert, state), self._none(state)
        if op.kind == "DELETE DATA":
            return self._none(state), _within(self._constant(op.delete, state), state)
        if op.kind == "MODIFY":
            return self._modify(op, state)
        if op.kind == "LOAD":
            try:
                if self.load is None:
                    raise UpdateError(f"no source for {op.source}")
                quads = self.load(op.source[1:-1])
            except Exception:
                if op.silent:
                    return self._none(state), self._none(state)
                raise
            return (quads if op.target is None else quads.withColumn("g", F.lit(op.target))), self._none(state)
        if op.kind in ("CLEAR", "DROP"):
            return self._none(state), state.where(_target(op.target))
        if op.kind == "CREATE":
            if not op.silent and not state.where(F.col("g") == op.target).isEmpty():
                raise UpdateError(f"graph {op.target} exists")
            return self._none(state), self._none(state)
        if op.source == op.target:
            return self._none(state), self._none(state)
        source = state.where(_target(op.source))
        if op.source != "DEFAULT" and not op.silent and source.isEmpty():
            raise UpdateError(f"no graph {op.source}")
        moved = source.withColumn("g", F.lit(None if op.target == "DEFAULT" else op.target).cast("string"))
        removed = self._none(state)
        if op.kind in ("COPY", "MOVE"):
            removed = _without(state.where(_target(op.target)), moved)
        if op.kind == "MOVE":
            removed = removed.unionByName(source)
        return moved, removed

    def _modify(self, op: A.Operation, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One evaluation of the pattern; both templates are filled from its stored solutions."""
        source = Dataset(state)
        if op.using or op.using_named:
            source = source.with_dataset(op.using, op.using_named)
        elif op.with_graph:
            named = Dataset(state)
            source = _With(named.df, default=(op.with_graph,))
        frame = Compiler(state.sparkSession, source, Context()).compile(optimise(op.pattern), DEFAULT)
        frame = frame.as_terms(set(frame.reps))
        frame = Frame(cut(frame.df), frame.reps, frame.certain)
        removed = _within(instantiate(frame, list(op.delete), op.with_graph), state) if op.delete else self._none(state)
        added = instantiate(frame, list(op.insert), op.with_graph) if op.insert else self._none(state)
        return added, _without(removed, added)


class _With(Dataset):
    """WITH replaces the default graph and leaves the named graphs."""


def _target(name: str | None):
    if name == "DEFAULT":
        return F.col("g").isNull()
    if name == "NAMED":
        return F.col("g").isNotNull()
    return F.lit(True) if name == "ALL" else F.col("g") == name

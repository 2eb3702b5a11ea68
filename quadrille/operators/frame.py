"""Frames of solutions: one nullable column for each variable, NULL where it is unbound."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.values import TERM, Rep, Value, to_term, with_lanes

#: The hidden variable that holds the graph under GRAPH ?g.
GRAPH = ".g"


def column_of(name: str) -> str:
    """The column of a variable; letters, digits and _ stay."""
    return "v_" + re.sub(r"[^A-Za-z0-9]", lambda m: f"_{ord(m[0])}_", name)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    reps: dict[str, Rep]
    certain: frozenset[str] = field(default_factory=frozenset)

    def col(self, name: str) -> Column:
        return F.col(column_of(name))

    def value(self, name: str) -> Value:
        return Value(self.col(name), self.reps[name])

    def values(self) -> dict[str, Value]:
        return {n: self.value(n) for n in self.reps}

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition))

    def select(self, names: list[str]) -> Frame:
        """Only these variables; those it lacks are unbound."""
        kept = [n for n in dict.fromkeys(names)]
        columns = [self.col(n) if n in self.reps else F.lit(None).cast("string").alias(column_of(n)) for n in kept]
        return Frame(self.df.select(*columns) if columns else self.df.select(F.lit(0).alias("_")), {n: self.reps.get(n, TERM) for n in kept}, self.certain & set(kept))

    def as_terms(self, names: set[str]) -> Frame:
        """These variables as term strings."""
        changed = {n for n in names if n in self.reps and self.reps[n] != TERM}
        if not changed:
            return self
        df = self.df.withColumns({column_of(n): to_term(self.col(n), self.reps[n]) for n in changed})
        return replace(self, df=df, reps={n: TERM if n in changed else r for n, r in self.reps.items()})

    def laned(self, names: set[str]) -> tuple[Frame, dict[str, Value]]:
        """The frame with the parts of these variables' terms as columns, and all values over it; ``select`` drops the columns again."""
        df, lanes = self.df, {}
        for n in sorted(names):
            if self.reps.get(n) == TERM:
                df, lanes[n] = with_lanes(df, column_of(n))
        frame = replace(self, df=df)
        return frame, {n: Value(frame.col(n), r, lanes=lanes.get(n)) for n, r in self.reps.items()}

    def bind(self, name: str, value: Value) -> Frame:
        if value.kind != "number":
            return replace(self, df=self.df.withColumn(column_of(name), value.col), reps={**self.reps, name: value.rep})
        # the number's term is a large expression that others would take apart again: made by a
        # generator it is a value that the optimiser does not copy into what reads it
        kept = [F.col(f"`{c}`") for c in self.df.columns if c != column_of(name)]
        df = self.df.select(*kept, F.explode(F.array(value.term)).alias(column_of(name)))
        return replace(self, df=df, reps={**self.reps, name: TERM})


def agreed(a: Frame, b: Frame) -> tuple[Frame, Frame]:
    """Both frames with shared variables in one representation."""
    differ = {n for n in a.reps.keys() & b.reps.keys() if a.reps[n] != b.reps[n]}
    return a.as_terms(differ), b.as_terms(differ)

"""Joins on compatibility: equal on every variable that both sides bind.

Variables that both sides always bind are plain equi-join keys.  For the others a side
is split by whether it binds them, so that what can be an equi-join is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.values import Value
from quadrille.operators.frame import Frame, agreed, column_of

_RIGHT = "r_"


def _renamed(frame: Frame) -> dict[str, str]:
    return {n: _RIGHT + column_of(n) for n in frame.reps}


def _sides(left: Frame, right: Frame):
    left, right = agreed(left, right)
    names = _renamed(right)
    rdf = right.df.select(*[right.col(n).alias(names[n]) for n in right.reps]) if right.reps else right.df.select(F.lit(0).alias("r__"))
    shared = [n for n in left.reps if n in right.reps]
    sure = [n for n in shared if n in left.certain and n in right.certain]
    return left, right, rdf, names, sure, [n for n in shared if n not in sure]


def _equal(n: str, names: dict[str, str]) -> Column:
    return F.col(column_of(n)) == F.col(names[n])


def _condition(sure: list[str], unsure: list[str], names: dict[str, str]) -> Column | None:
    parts = [_equal(n, names) for n in sure]
    parts += [F.col(column_of(n)).isNull() | F.col(names[n]).isNull() | _equal(n, names) for n in unsure]
    return reduce(lambda a, b: a & b, parts) if parts else None


def merged_values(left: Frame, right: Frame, names: dict[str, str]) -> dict[str, Value]:
    found = {n: Value(F.col(names[n]), right.reps[n]) for n in right.reps}
    for n in left.reps:
        both = F.col(column_of(n)) if n not in right.reps or n in left.certain else F.coalesce(F.col(column_of(n)), F.col(names[n]))
        found[n] = Value(both, left.reps[n])
    return found


def _merged(df, left: Frame, right: Frame, names: dict[str, str], certain: frozenset[str]) -> Frame:
    values = merged_values(left, right, names)
    reps = {n: v.rep for n, v in values.items()}
    return Frame(df.select(*[v.col.alias(column_of(n)) for n, v in values.items()]) if values else df.select(F.lit(0).alias("_")), reps, certain)


def join(left: Frame, right: Frame) -> Frame:
    left, right, rdf, names, sure, unsure = _sides(left, right)
    certain = left.certain | right.certain
    if unsure and not sure:
        # no key holds for all rows: split by whether the first unsure variable is bound
        n = unsure[0]
        a, b = left.col(n), right.col(n)
        parts = [_with_certain(left.where(a.isNotNull()), n, right.where(b.isNotNull()))]
        parts.append(_without(left.where(a.isNull()), n, right))
        if n not in right.certain:
            parts.append(_without(right.where(b.isNull()), n, left.where(a.isNotNull())))
        frames = [join(x, y) for x, y in parts]
        return reduce(union, frames)
    condition = _condition(sure, unsure, names)
    df = left.df.join(rdf, condition, "inner") if condition is not None else left.df.crossJoin(rdf)
    return _merged(df, left, right, names, certain)


def _with_certain(left: Frame, n: str, right: Frame) -> tuple[Frame, Frame]:
    return Frame(left.df, left.reps, left.certain | {n}), Frame(right.df, right.reps, right.certain | {n})


def _without(lacking: Frame, n: str, other: Frame) -> tuple[Frame, Frame]:
    """Rows of the first frame do not bind n, so it takes no part."""
    return lacking.select([x for x in lacking.reps if x != n]), other


def left_join(left: Frame, right: Frame, condition=None) -> Frame:
    """OPTIONAL; ``condition`` makes a column from the merged values and is part of the join.

    NULL joins nothing, as false does; the condition stays bare, since Catalyst finds join keys only among plain conjuncts.
    """
    left, right, rdf, names, sure, unsure = _sides(left, right)
    on = _condition(sure, unsure, names)
    if condition is not None:
        test = condition(merged_values(left, right, names))
        on = test if on is None else on & test
    return _merged(left.df.join(rdf, F.lit(True) if on is None else on, "left"), left, right, names, left.certain)


def minus(left: Frame, right: Frame) -> Frame:
    """Drop what is compatible with a right row and shares a bound variable with it."""
    left, right, rdf, names, sure, unsure = _sides(left, right)
    if not sure and not unsure:
        return left
    on = _condition(sure, unsure, names)
    if not sure:
        on = on & reduce(lambda a, b: a | b, [F.col(column_of(n)).isNotNull() & F.col(names[n]).isNotNull() for n in unsure])
    kept = rdf.select(*[names[n] for n in sure + unsure]).distinct()
    return Frame(left.df.join(kept, on, "left_anti"), left.reps, left.certain)


def exists(left: Frame, right: Frame, negated: bool, condition=None) -> Frame:
    left, right, rdf, names, sure, unsure = _sides(left, right)
    on = _condition(sure, unsure, names)
    if condition is not None:
        test = condition(merged_values(left, right, names))
        on = test if on is None else on & test
    elif sure or unsure:
        rdf = rdf.select(*[names[n] for n in sure + unsure]).distinct() if unsure else rdf
    else:
        rdf = rdf.limit(1)
    return Frame(left.df.join(rdf, F.lit(True) if on is None else on, "left_anti" if negated else "left_semi"), left.reps, left.certain)


def flagged(left: Frame, right: Frame, flag: str) -> Frame:
    """``left`` with a boolean column: whether a compatible right row exists."""
    left, right, rdf, names, sure, unsure = _sides(left, right)
    kept = rdf.select(*[names[n] for n in sure + unsure]).distinct() if sure or unsure else rdf.limit(1)
    kept = kept.withColumn("r__found", F.lit(True))
    on = _condition(sure, unsure, names)
    if unsure:  # a row may meet several: number the left rows and keep each once
        df = left.df.join(kept, on, "left_semi").distinct().withColumn("r__found", F.lit(True))
        back = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"b__{c}")) for c in left.df.columns])
        df = left.df.join(df.select(*[F.col(c).alias(f"b__{c}") for c in left.df.columns], "r__found"), back, "left").select(*left.df.columns, "r__found")
    else:
        df = left.df.join(kept, F.lit(True) if on is None else on, "left")
    df = df.select(*left.df.columns, F.coalesce("r__found", F.lit(False)).alias(flag))
    return Frame(df, left.reps, left.certain)


def union(left: Frame, right: Frame) -> Frame:
    left, right = agreed(left, right)
    names = list(dict.fromkeys([*left.reps, *right.reps]))

    def padded(frame: Frame, other: Frame):
        columns = [frame.col(n) if n in frame.reps else F.lit(None).cast(other.df.schema[column_of(n)].dataType).alias(column_of(n)) for n in names]
        return frame.df.select(*columns) if columns else frame.df.select(F.lit(0).alias("_"))

    return Frame(padded(left, right).unionByName(padded(right, left)), {**right.reps, **left.reps}, left.certain & right.certain)

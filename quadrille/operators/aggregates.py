"""GROUP BY and aggregates with SPARQL's error rules.

One unbound value makes SUM, AVG, MIN, MAX and GROUP_CONCAT of its group unbound; COUNT
and SAMPLE skip it.  SUM and AVG of nothing are 0, GROUP_CONCAT of nothing is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import values as V
from quadrille.functions.values import DEC, DOUBLE, INTEGER, STRING, TERM, Number, Rep, Value
from quadrille.operators.frame import GRAPH, Frame, column_of
from quadrille.plans import algebra as A


def _guarded(found: Column, arg: Column, certain: bool) -> Column:
    """NULL if any value of the group is."""
    return found if certain else F.when(F.count(arg) == F.count(F.lit(1)), found)


def _empty(found: Column, other: Column) -> Column:
    return F.when(F.count(F.lit(1)) == 0, other).otherwise(found)


def _sum(v: Value, certain: bool, average: bool, keyed: bool) -> Value:
    n = v.number
    if n is None:
        return Value(F.when(F.count(F.lit(1)) == 0, f'"0"^^<{V.XSD}integer>'), TERM)
    counted = F.count(F.lit(1))
    if v.kind == "integer":
        total = F.coalesce(F.try_sum(v.col), F.when(counted == 0, 0).cast("bigint"))
        if not average:
            return Value(_guarded(total, v.col, certain), INTEGER)
        mean = V._divide(total, counted, True)
        if keyed:
            return Value(_guarded(mean, v.col, certain), DEC)
        exact = _guarded(_empty(mean, F.lit(0).cast(V.DECIMAL)), v.col, certain)
        return Value(V.null(), Rep("number"), Number(F.when(counted == 0, 1).otherwise(2), exact, exact.cast("double")))
    if v.kind == "double" and keyed:
        return Value(_guarded(F.avg(v.col) if average else F.sum(v.col), v.col, certain), DOUBLE)
    rank_of = F.lit(n.rank) if isinstance(n.rank, int) else n.rank
    rank = _guarded(F.coalesce(F.max(rank_of), F.lit(1)), rank_of, False)
    exact = F.coalesce(F.try_sum(n.exact.cast(V.DECIMAL)), F.lit(0)).try_cast(V.DECIMAL) if n.exact is not None else F.lit(0).cast(V.DECIMAL)
    approx = F.coalesce(F.sum(n.approx), F.lit(0.0))
    if average:
        exact = F.when(counted == 0, F.lit(0).cast(V.DECIMAL)).otherwise(F.coalesce(V._divide(exact, counted, False), V._divide(exact, counted, True)))
        approx = F.when(counted == 0, 0.0).otherwise(F.try_divide(approx, counted))
        rank = F.when((rank == 1) & (counted > 0), 2).otherwise(rank)
    rank = F.when((rank >= 3) | exact.isNotNull(), rank)
    return Value(V.null(), Rep("number"), Number(rank, exact, approx))


def _extreme(v: Value, certain: bool, largest: bool) -> Value:
    if v.kind in ("integer", "decimal", "double", "string", "boolean", "dateTime"):
        return Value(_guarded((F.max if largest else F.min)(v.col), v.col, certain), v.rep)
    t = v.term
    return Value(_guarded((F.max_by if largest else F.min_by)(t, V.sort_key(v)), t, certain), TERM)


def _one(a: A.Aggregate, v: Value | None, certain: bool, keyed: bool, frame: Frame, custom) -> Value:
    if a.name == "COUNT":
        if v is None:
            whole = F.struct(*[F.col(column_of(n)) for n in frame.reps if not n.startswith((".", "_:"))] or [F.lit(0)])
            return Value(F.count_distinct(whole) if a.distinct else F.count(F.lit(1)), INTEGER)
        col = v.term if v.kind == "number" else v.col
        return Value(F.count_distinct(col) if a.distinct else F.count(col), INTEGER)
    if a.name in ("SUM", "AVG"):
        return _sum(v, certain, a.name == "AVG", keyed)
    if a.name in ("MIN", "MAX"):
        return _extreme(v, certain, a.name == "MAX")
    if a.name == "SAMPLE":
        return Value(F.min(v.term if v.kind == "number" else v.col), TERM if v.kind == "number" else v.rep)
    if a.name == "GROUP_CONCAT":
        t = v.term
        lex = v.col if v.kind == "string" else v.lex
        parts = F.array_join(F.sort_array(F.collect_list(lex)), a.separator)
        return Value(_guarded(parts, lex, certain and v.kind == "string"), STRING)
    if a.name in custom:
        return Value(custom[a.name](v.term), TERM)
    raise ValueError(f"unknown aggregate {a.name}")


def group(frame: Frame, node: A.Group, expressions, custom) -> Frame:
    """``expressions`` compiles over the frame; aggregates of distinct values run over distinct rows of their own."""
    keys = {n: expressions.value(e) for n, e in node.keys}
    if GRAPH in frame.reps:
        keys[GRAPH] = frame.value(GRAPH)
    keyed = bool(keys)
    key_columns = [(v.term if v.kind == "number" else v.col).alias(column_of(n)) for n, v in keys.items()]
    reps: dict[str, Rep] = {n: TERM if v.kind == "number" else v.rep for n, v in keys.items()}

    def run(df, aggregates, over) -> tuple:
        columns, found = [], {}
        for name, a in aggregates:
            v = over(a)
            certain = isinstance(a.arg, A.Var) and a.arg.name in frame.certain
            out = _one(a, v, certain, keyed, frame, custom)
            found[name] = TERM if out.kind == "number" else out.rep
            columns.append((out.term if out.kind == "number" else out.col).alias(column_of(name)))
        grouped = df.groupBy(*key_columns) if over is plain else df.groupBy(*[F.col(column_of(n)) for n in keys])
        return (grouped.agg(*columns) if columns else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")), found

    def plain(a: A.Aggregate) -> Value | None:
        return None if a.arg is None else expressions.value(a.arg)

    apart = [(n, a) for n, a in node.aggregates if a.distinct and a.name not in ("COUNT", "MIN", "MAX", "SAMPLE")]
    df, found = run(frame.df, [x for x in node.aggregates if x not in apart], plain)
    reps |= found
    for name, a in apart:
        v = plain(a)
        rep = TERM if v.kind == "number" else v.rep
        rows = frame.df.select(*key_columns, (v.term if v.kind == "number" else v.col).alias("_arg")).distinct()
        part, found = run(rows, [(name, A.Aggregate(a.name, a.arg, False, a.separator))], lambda _, rep=rep: Value(F.col("_arg"), rep))
        reps |= found
        part = part.select(*[F.col(column_of(n)).alias(f"k_{column_of(n)}") for n in keys], column_of(name))
        on = [F.col(column_of(n)).eqNullSafe(F.col(f"k_{column_of(n)}")) for n in keys]
        df = df.join(part, reduce(lambda x, y: x & y, on), "left") if on else df.crossJoin(part)
        df = df.select(*[c for c in df.columns if not c.startswith("k_")])
    certain = A.certain(node) | ({GRAPH} if GRAPH in keys else set())
    return Frame(df, reps, frozenset(n for n in certain if n in reps))

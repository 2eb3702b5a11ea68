"""Domain events: what commits assert about event nodes, as CloudEvents in JSON.

An event occurs where a commit asserts ``(e, rdf:type, C)`` for a declared class C,
exactly.  Its declaration's SELECT is evaluated over the state of that commit; it must
give one row for the event, else the occurrence is a problem at its ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.engine import Engine
from quadrille.functions import values as V
from quadrille.functions.values import TERM, Value
from quadrille.store import Store
from quadrille.terms import TYPE


@dataclass(frozen=True)
class EventType:
    """``fields`` maps JSON names to (variable, required)."""

    cls: str
    name: str
    version: str
    select: str
    subject: str
    fields: dict[str, tuple[str, bool]]


def occurrences(store: Store, types: list[EventType], after: int, to: int) -> DataFrame:
    """(position, ordinal, node, cls): events of the commits in (after, to], IRIs before blank nodes, by name."""
    found = store.changes(after, to).where((F.col("op") == "+") & (F.col("p") == TYPE) & F.col("o").isin([t.cls for t in types]))
    return numbered(found.select("position", F.col("s").alias("node"), F.col("o").alias("cls")).distinct())


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with their ordinals.  A commit's rows are sorted in many tasks: a row's number is its place in its task, after the rows of the tasks before."""
    order = ["position", F.col("node").startswith("_:"), "node", "cls"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumn("task", F.shiftright("place", 33)).persist()
    tasks = placed.groupBy("position", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("position").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("position", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("start"))
    return placed.join(F.broadcast(starts), ["position", "task"]).select("position", "node", "cls", (F.col("place") + F.col("start")).cast("int").alias("ordinal"))


def json_value(v: Value) -> Column:
    """A term in JSON: exact numbers and booleans as such, everything else as its text."""
    term, n = v.col, v.number
    text = F.to_json(F.array(F.coalesce(v.lex, term.substr(F.lit(2), F.length(term) - 2))))
    quoted = text.substr(F.lit(2), F.length(text) - 2)
    number = F.when(n.rank == 1, n.exact.cast("bigint").cast("string")).when(n.rank == 2, F.regexp_replace(V.decimal_text(n.exact), r"\.0$", "")).when((n.rank >= 3) & ~F.isnan(n.approx) & (F.abs(n.approx) != float("inf")), n.approx.cast("string"))
    return F.coalesce(number, v.boolean.cast("string"), quoted)


def render(spark: SparkSession, store: Store, types: list[EventType], after: int, to: int) -> DataFrame:
    """(position, ordinal, node, event, problem): one row for every occurrence, the event in canonical key order."""
    seen = occurrences(store, types, after, to)
    parts = []
    positions = [r[0] for r in seen.select("position").distinct().collect()]
    for position in sorted(positions):
        engine = Engine(spark, store.dataset(position))
        for t in types:
            here = seen.where((F.col("position") == position) & (F.col("cls") == t.cls))
            rows = engine.select(t.select)
            rows = rows.select(*[F.col(f"`{c}`").alias("node" if c == t.subject else f"f_{c}") for c in rows.columns])
            fields = {name: f"f_{variable}" for name, (variable, _) in sorted(t.fields.items())}
            one = rows.groupBy("node").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in dict.fromkeys(fields.values())])
            joined = here.join(one, "node", "left")
            missing = reduce(lambda a, b: a | b, [F.col(f"f_{v}").isNull() for v, required in t.fields.values() if required], F.lit(False))
            problem = F.when(F.coalesce("n", F.lit(0)) != 1, F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows"))).when(missing, "a required field is missing")
            lanes = {}
            for c in dict.fromkeys(fields.values()):
                joined, lanes[c] = V.with_lanes(joined, c)
            joined = joined.withColumns({f"j_{name}": json_value(Value(F.col(c), TERM, lanes=lanes[c])) for name, c in fields.items()})
            data = F.concat(F.lit("{"), F.concat_ws(",", *[F.when(F.col(f"j_{name}").isNotNull(), F.concat(F.lit(f'"{name}":'), F.col(f"j_{name}"))) for name in fields]), F.lit("}"))
            identity = F.concat(F.lit(f"{position}-"), F.col("ordinal").cast("string"))
            event = F.concat(F.lit('{"data":'), data, F.lit(',"datacontenttype":"application/json","id":"'), identity, F.lit(f'","source":"{store.path.rsplit("/", 1)[-1]}","specversion":"1.0","type":"{t.name}","version":"{t.version}"}}'))
            parts.append(joined.select("position", "ordinal", "node", F.when(problem.isNull(), event).alias("event"), problem.alias("problem")))
    if not parts:
        return spark.createDataFrame([], "position long, ordinal int, node string, event string, problem string")
    return reduce(DataFrame.unionByName, parts)

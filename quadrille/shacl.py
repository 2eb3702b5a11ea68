"""SHACL Core validation: every constraint is a DataFrame of violations, the report their union.

Shapes are small and are read on the driver.  Focus nodes, value nodes and violations
are frames, so validation scales with the data.  Shapes that refer to themselves are
refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import values as V
from quadrille.functions.scalar import java_regex
from quadrille.functions.values import TERM, Value
from quadrille.operators.paths import Relation, closure, relation
from quadrille.plans import algebra as A
from quadrille.plans.compiler import _PathSource
from quadrille.sources.quads import DEFAULT, Dataset
from quadrille.terms import FIRST, NIL, RDFS, REST, SH, TYPE, parse_literal

REPORT = ["focus", "path", "value", "component", "shape", "severity", "message"]
_SUB_CLASS = f"<{RDFS}subClassOf>"


def sh(name: str) -> str:
    return f"<{SH}{name}>"


class RecursiveShapes(ValueError):
    pass


@dataclass
class Shapes:
    """A shapes graph on the driver."""

    triples: list[tuple[str, str, str]]

    def __post_init__(self):
        self.by: dict[tuple[str, str], list[str]] = {}
        for s, p, o in self.triples:
            self.by.setdefault((s, p), []).append(o)

    def all(self, s: str, name: str) -> list[str]:
        return self.by.get((s, sh(name)), [])

    def one(self, s: str, name: str) -> str | None:
        return next(iter(self.all(s, name)), None)

    def list(self, head: str) -> list[str]:
        out = []
        while head != NIL:
            out += self.by.get((head, FIRST), [])
            head = self.by.get((head, REST), [NIL])[0]
        return out

    def number(self, s: str, name: str) -> int | None:
        found = self.one(s, name)
        return None if found is None else int(parse_literal(found).lex)

    def path(self, node: str) -> A.Node:
        for name, zero, many in (("zeroOrMorePath", True, True), ("oneOrMorePath", False, True), ("zeroOrOnePath", True, False)):
            if found := self.one(node, name):
                return A.Repeat(self.path(found), zero, many)
        if found := self.one(node, "inversePath"):
            return A.Inverse(self.path(found))
        if found := self.one(node, "alternativePath"):
            return reduce(A.Alt, map(self.path, self.list(found)))
        if (node, FIRST) in self.by:
            return reduce(A.Seq, map(self.path, self.list(node)))
        return A.Link(node)

    def with_targets(self) -> list[str]:
        names = [sh(n) for n in ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf")]
        kinds = [sh("NodeShape"), sh("PropertyShape")]
        implicit = {s for s, p, o in self.triples if p == TYPE and o in kinds and f"<{RDFS}Class>" in self.by.get((s, TYPE), [])}
        return sorted({s for s, p, _ in self.triples if p in names} | implicit)


@dataclass
class Validator:
    spark: SparkSession
    data: DataFrame
    shapes: Shapes

    def __post_init__(self):
        self.source = Dataset(self.data.select("s", "p", "o", F.lit(None).cast("string").alias("g")))
        self.paths = _PathSource(self.source, DEFAULT)
        self._types: DataFrame | None = None

    # --- nodes -------------------------------------------------------------------------

    def types(self) -> DataFrame:
        """(node, class), sub-classes included."""
        if self._types is None:
            direct = self.data.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("class"))
            edges = self.data.where(F.col("p") == _SUB_CLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))
            up = closure(Relation(edges)).df
            self._types = direct.unionByName(direct.join(up, F.col("class") == F.col("a")).select("node", F.col("b").alias("class"))).distinct()
        return self._types

    def targets(self, shape: str) -> DataFrame:
        found = [self.spark.createDataFrame([(n,) for n in self.shapes.all(shape, "targetNode")], "focus string")]
        classes = list(self.shapes.all(shape, "targetClass"))
        if f"<{RDFS}Class>" in self.shapes.by.get((shape, TYPE), []):
            classes.append(shape)
        if classes:
            found.append(self.types().where(F.col("class").isin(classes)).select(F.col("node").alias("focus")))
        for name, column in (("targetSubjectsOf", "s"), ("targetObjectsOf", "o")):
            if predicates := self.shapes.all(shape, name):
                found.append(self.data.where(F.col("p").isin(predicates)).select(F.col(column).alias("focus")))
        return reduce(DataFrame.unionByName, found).distinct()

    def values(self, shape: str, focus: DataFrame) -> tuple[DataFrame, str | None]:
        """(focus, value): the focus node itself, or what the shape's path leads to, as a set."""
        path = self.shapes.one(shape, "path")
        if path is None:
            return focus.select("focus", F.col("focus").alias("value")), None
        pairs = relation(self.shapes.path(path), self.paths).terms().df
        return focus.join(pairs, F.col("focus") == F.col("a")).select("focus", F.col("b").alias("value")).distinct(), path

    # --- validation ----------------------------------------------------------------------

    def validate(self) -> DataFrame:
        """The report: a row for each result."""
        parts = [self.check(s, self.targets(s)) for s in self.shapes.with_targets()]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT)))

    def conforms(self) -> bool:
        return self.validate().where(F.col("severity").isin(sh("Violation"), sh("Warning"), sh("Info"))).isEmpty()

    def failing(self, shape: str, nodes: DataFrame, above: tuple[str, ...]) -> DataFrame:
        """(focus): the nodes (focus) that do not conform to a shape."""
        return self.check(shape, nodes, above).select("focus").distinct()

    def check(self, shape: str, focus: DataFrame, above: tuple[str, ...] = ()) -> DataFrame:
        if shape in above:
            raise RecursiveShapes(f"{shape} refers to itself")
        above = (*above, shape)
        empty = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT))
        if self.shapes.one(shape, "deactivated") and "true" in self.shapes.one(shape, "deactivated"):
            return empty
        values, path = self.values(shape, focus)
        severity = self.shapes.one(shape, "severity") or sh("Violation")
        message = self.shapes.one(shape, "message")
        found: list[DataFrame] = []

        def report(bad: DataFrame, component: str) -> None:
            value = F.col("value") if "value" in bad.columns else F.lit(None).cast("string")
            found.append(bad.select("focus", F.lit(path).cast("string").alias("path"), value.alias("value"), F.lit(sh(component)).alias("component"), F.lit(shape).alias("shape"), F.lit(severity).alias("severity"), F.lit(message).cast("string").alias("message")))

        def each(component: str, good: Column) -> None:
            """Values for which a test is not true."""
            report(values.where(~F.coalesce(good, F.lit(False))), component)

        v = Value(F.col("value"), TERM)
        get = self.shapes
        self._value_types(shape, values, v, report, each)
        for name, op in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
            for bound in get.all(shape, name):
                limit = V.numeric_constant(bound) or V.constant(bound)
                each(f"{name[0].upper()}{name[1:]}ConstraintComponent", V.compare(op, v, limit))
        text = F.when(~F.col("value").startswith("_"), F.coalesce(v.lex, F.expr("substring(value, 2, length(value) - 2)")))
        for name, good in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n)):
            if (n := get.number(shape, name)) is not None:
                each(f"{name[0].upper()}{name[1:]}ConstraintComponent", good(n))
        for pattern in get.all(shape, "pattern"):
            flags = get.one(shape, "flags")
            regex, _ = java_regex(parse_literal(pattern).lex, parse_literal(flags).lex if flags else "")
            each("PatternConstraintComponent", text.rlike(regex))
        if any("true" in x for x in get.all(shape, "singleLine")):
            each("SingleLineConstraintComponent", ~text.rlike(r"[\n\r]"))
        for head in get.all(shape, "languageIn"):
            tags = [parse_literal(t).lex.lower() for t in get.list(head)]
            lang = V.lang_of(F.col("value"))
            each("LanguageInConstraintComponent", reduce(lambda a, b: a | b, [(lang == t) | lang.startswith(f"{t}-") for t in tags], F.lit(False)))
        for head in get.all(shape, "in"):
            each("InConstraintComponent", F.col("value").isin(get.list(head)))
        self._counts(shape, focus, values, report)
        self._pairs(shape, focus, values, report)
        for head in get.all(shape, "hasValue"):
            having = values.where(F.col("value") == head).select("focus")
            report(focus.join(having, "focus", "left_anti"), "HasValueConstraintComponent")
        if any("true" in x for x in get.all(shape, "uniqueLang")):
            twice = values.withColumn("lang", V.lang_of(F.col("value"))).where("lang != ''").groupBy("focus", "lang").count().where("count > 1")
            report(twice.select("focus"), "UniqueLangConstraintComponent")
        if any("true" in x for x in get.all(shape, "closed")):
            allowed = [get.one(p, "path") for p in get.all(shape, "property")] + [x for h in get.all(shape, "ignoredProperties") for x in get.list(h)]
            extra = focus.join(self.data, F.col("focus") == F.col("s")).where(~F.col("p").isin([a for a in allowed if a]))
            report(extra.select("focus", F.col("o").alias("value")), "ClosedConstraintComponent")
        self._logic(shape, focus, values, report, above)
        for inner in get.all(shape, "property"):
            nodes = values.select(F.col("value").alias("focus")).distinct()
            found.append(self.check(inner, nodes, above))
        return reduce(DataFrame.unionByName, found, empty)

    def _value_types(self, shape: str, values: DataFrame, v: Value, report: Callable, each: Callable) -> None:
        get = self.shapes
        for c in get.all(shape, "class"):
            good = self.types().where(F.col("class").isin(get.list(c) or [c])).select(F.col("node").alias("value"))
            report(values.join(good, "value", "left_anti").select("focus", "value"), "ClassConstraintComponent")
        for d in get.all(shape, "datatype"):
            well = F.lit(True)
            name = d[1:-1].rpartition("#")[2]
            if name in V.INTEGERS or name in ("decimal", "float", "double"):
                well = v.number.rank.isNotNull()
            elif name == "boolean":
                well = v.boolean.isNotNull()
            elif name == "dateTime":
                well = v.instant.isNotNull()
            elif name == "date":
                well = v.lex.rlike(V.DATE_FORM)
            each("DatatypeConstraintComponent", (v.datatype == d[1:-1]) & well)
        for k in get.all(shape, "nodeKind"):
            kinds = k[1:-1].rpartition("#")[2]
            kind = V.kind_of(F.col("value"))
            wanted = [x for x, word in (("i", "IRI"), ("b", "BlankNode"), ("l", "Literal")) if word in kinds]
            each("NodeKindConstraintComponent", kind.isin(wanted))

    def _counts(self, shape: str, focus: DataFrame, values: DataFrame, report: Callable) -> None:
        low, high = self.shapes.number(shape, "minCount"), self.shapes.number(shape, "maxCount")
        if low is None and high is None:
            return
        counted = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if low is not None:
            report(counted.where(F.col("n") < low).select("focus"), "MinCountConstraintComponent")
        if high is not None:
            report(counted.where(F.col("n") > high).select("focus"), "MaxCountConstraintComponent")

    def _pairs(self, shape: str, focus: DataFrame, values: DataFrame, report: Callable) -> None:
        for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for predicate in self.shapes.all(shape, name):
                component = f"{name[0].upper()}{name[1:]}ConstraintComponent"
                other = self.data.where(F.col("p") == predicate).select(F.col("s").alias("focus"), F.col("o").alias("value"))
                if name == "equals":
                    report(values.join(other, ["focus", "value"], "left_anti"), component)
                    report(other.distinct().join(focus, "focus", "left_semi").join(values, ["focus", "value"], "left_anti"), component)
                elif name == "disjoint":
                    report(values.join(other, ["focus", "value"], "left_semi"), component)
                else:
                    pairs = values.join(other.withColumnRenamed("value", "other"), "focus")
                    good = V.compare("<" if name == "lessThan" else "<=", Value(F.col("value"), TERM), Value(F.col("other"), TERM))
                    report(pairs.where(~F.coalesce(good, F.lit(False))).select("focus", "value"), component)

    def _logic(self, shape: str, focus: DataFrame, values: DataFrame, report: Callable, above: tuple[str, ...]) -> None:
        get = self.shapes
        nodes = values.select(F.col("value").alias("focus")).distinct()

        def bad(inner: str) -> DataFrame:
            return self.failing(inner, nodes, above).select(F.col("focus").alias("value"))

        for inner in get.all(shape, "node"):
            report(values.join(bad(inner), "value", "left_semi"), "NodeConstraintComponent")
        for inner in get.all(shape, "not"):
            report(values.join(bad(inner), "value", "left_anti"), "NotConstraintComponent")
        for name in ("and", "or", "xone"):
            for head in get.all(shape, name):
                members = get.list(head)
                failed = reduce(DataFrame.unionByName, [bad(m) for m in members]).groupBy("value").agg(F.count("*").alias("n"))
                joined = values.join(failed, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                test = {"and": F.col("n") > 0, "or": F.col("n") == len(members), "xone": F.col("n") != len(members) - 1}[name]
                report(joined.where(test).select("focus", "value"), f"{name.capitalize()}ConstraintComponent")
        for inner in get.all(shape, "qualifiedValueShape"):
            good = values.join(bad(inner), "value", "left_anti").groupBy("focus").agg(F.count("*").alias("n"))
            counted = focus.select("focus").distinct().join(good, "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            low, high = get.number(shape, "qualifiedMinCount"), get.number(shape, "qualifiedMaxCount")
            if low is not None:
                report(counted.where(F.col("n") < low).select("focus"), "QualifiedMinCountConstraintComponent")
            if high is not None:
                report(counted.where(F.col("n") > high).select("focus"), "QualifiedMaxCountConstraintComponent")


def validate(spark: SparkSession, data: DataFrame, shapes: list[tuple]) -> DataFrame:
    """The report of data (s, p, o) against shapes, a list of triples or quads."""
    return Validator(spark, data, Shapes([q[:3] for q in shapes])).validate()


def gate(spark: SparkSession, shapes: list[tuple], mode: str = "reject"):
    """A store's validator: refuses a commit whose state would not conform, or lets it pass (``report``)."""

    def check(after: DataFrame, delta: DataFrame) -> str | None:
        bad = validate(spark, after, shapes).where(F.col("severity") == sh("Violation")).limit(1).collect()
        return f"{bad[0]['focus']} violates {bad[0]['shape']}" if bad and mode == "reject" else None

    return check

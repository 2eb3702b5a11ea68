"""An append-only store of quads on plain files.

``changes/pos=P`` holds the effective delta of commit P as Parquet; it is written first.
``commits/P.json``, created only if absent, makes the commit visible: the head is the
largest P without a gap before it.  A crash between the two leaves files that the next
commit of P replaces.  A state is the nearest checkpoint at or before a position and the
net of the changes since; every read of a position is stable for good.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.sources.quads import SCHEMA, Dataset

QUAD = ["s", "p", "o", "g"]
DEFAULT_GRAPH = "DEFAULT"


class Conflict(RuntimeError):
    """The expected position is behind a commit that touched the scope."""


class Rejected(RuntimeError):
    """A validator refused the commit."""


class NotWritable(RuntimeError):
    """A quad lies outside the graphs that the caller may write."""


@dataclass(frozen=True)
class Commit:
    position: int
    kind: str = "data"
    timestamp: str = ""
    agent: str = ""
    cause: str = ""
    key: str = ""
    attachments: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    asserted: int = 0
    retracted: int = 0
    content: str = ""
    previous: str = ""
    #: The folder of its changes under the position; that of a writer who lost the position is never read.
    part: str = ""


@dataclass(frozen=True)
class Outcome:
    status: str  # committed, no change, repeated
    position: int


Validator = Callable[[DataFrame, DataFrame], str | None]


def same_quad(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in "spo"]) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))


def _without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("l").join(right.select(*QUAD).alias("r"), same_quad("l", "r"), "left_anti")


def _within(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("l").join(right.select(*QUAD).alias("r"), same_quad("l", "r"), "left_semi")


def overlay(base: DataFrame, asserted: DataFrame, retracted: DataFrame) -> DataFrame:
    """(base - retracted) + asserted, of quads."""
    return _without(base, retracted).unionByName(_without(asserted.select(*QUAD), base).distinct())


def net(changes: DataFrame) -> DataFrame:
    """The net of a window of exact deltas (position, op, quad): the quads whose first and last operation agree.

    Position and operation are one number, odd for a retraction, so that the aggregation hashes and need not sort.
    """
    at = F.col("position") * 2 + F.when(F.col("op") == "-", 1).otherwise(0)
    ends = changes.groupBy(*QUAD).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return ends.where("first % 2 = last % 2").select(F.when(F.col("last") % 2 == 1, "-").otherwise("+").alias("op"), *QUAD)


def last_operations(operations: DataFrame) -> DataFrame:
    """(quad, op): of several operations (op, quad[, seq]) on one quad the last by ``seq``, then the retraction."""
    code = F.when(F.col("op") == "+", 1).when(F.col("op") == "-", 2).otherwise(0)
    if "seq" not in operations.columns:
        # quads that hardly repeat: grouping them before the shuffle too would save nothing
        found = operations.repartition(*QUAD).groupBy(*QUAD).agg(F.max(code).alias("code"))
    elif isinstance(operations.schema["seq"].dataType, T.IntegralType):  # one number, as in ``net``; NULL comes first
        seq = F.coalesce(F.col("seq").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
        found = operations.groupBy(*QUAD).agg(F.max(seq * 4 + code).alias("last")).withColumn("code", F.pmod("last", F.lit(4)))
    else:
        return operations.groupBy(*QUAD).agg(F.max_by("op", F.struct("seq", F.col("op"))).alias("op"))
    return found.select(*QUAD, F.when(F.col("code") == 1, "+").when(F.col("code") == 2, "-").alias("op"))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, as a plan that the optimiser sees to be empty, so that joins with it vanish."""
    fields = [f.split() for f in schema.split(", ")]
    return spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])


@dataclass
class Store:
    spark: SparkSession
    path: str
    validators: list[Validator] = field(default_factory=list)
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    key_window: int = 1000

    # --- files -----------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, name: str) -> str | None:
        jvm, fs = self._fs()
        if not fs.exists(self._path(name)):
            return None
        stream = fs.open(self._path(name))
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> bool:
        """Create a file; False if it exists."""
        jvm, fs = self._fs()
        try:
            stream = fs.create(self._path(name), False)
        except Exception as error:
            if "exist" in str(error).lower():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def commit(self, position: int) -> Commit | None:
        text = self._read(f"commits/{position:012d}.json")
        if text is None:
            return None
        data = json.loads(text)
        return Commit(**{**data, "attachments": tuple(data["attachments"]), "graphs": tuple(data["graphs"])})

    def head(self) -> int:
        """The largest position that every smaller one leads to; found by doubling."""
        if self._read("commits/000000000001.json") is None:
            return 0
        low, high = 1, 2
        while self._exists(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._exists(middle) else (low, middle)
        return low

    def _exists(self, position: int) -> bool:
        return self._fs()[1].exists(self._path(f"commits/{position:012d}.json"))

    def commits(self) -> DataFrame:
        """A row for each visible commit."""
        schema = "position long, kind string, timestamp string, agent string, cause string, key string, attachments array<string>, graphs array<string>, asserted long, retracted long, content string, previous string, part string"
        if not self.head():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/commits/*.json").where(F.col("position") <= self.head())

    # --- reads -----------------------------------------------------------------------

    def changes(self, after: int = 0, to: int | None = None) -> DataFrame:
        """(position, op, quad) of the commits in (after, to]."""
        to = self.head() if to is None else to
        schema = "op string, s string, p string, o string, g string"
        if min(to, self.head()) <= after:
            return _empty(self.spark, "position long, " + schema)
        df = self.spark.read.schema(schema + ", pos long, part string").option("basePath", f"{self.path}/changes").parquet(f"{self.path}/changes")
        df = df.where((F.col("pos") > after) & (F.col("pos") <= to)).withColumnRenamed("pos", "position")
        won = self.commits().where((F.col("position") > after) & (F.col("position") <= to)).select("position", "part")
        return df.join(won, ["position", "part"]).select("position", "op", *QUAD)

    def checkpoints(self) -> list[int]:
        jvm, fs = self._fs()
        folder = self._path("snapshots")
        if not fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        return sorted(int(n[4:]) for n in names if n.startswith("pos=") and fs.exists(self._path(f"snapshots/{n}/_SUCCESS")))

    def quads(self, position: int | None = None) -> DataFrame:
        """The state at a position; the head without one."""
        position = self.head() if position is None else position
        base = max([p for p in self.checkpoints() if p <= position], default=0)
        state = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/snapshots/pos={base}") if base else _empty(self.spark, "s string, p string, o string, g string")
        if base == position:
            return state
        delta = self.diff(base, position)
        if not base:
            return delta.where("op = '+'").select(*QUAD)
        return overlay(state, delta.where("op = '+'"), delta.where("op = '-'"))

    def dataset(self, position: int | None = None) -> Dataset:
        return Dataset(self.quads(position))

    def position_at(self, moment: str) -> int:
        """The last position not after a time (RFC 3339)."""
        found = self.commits().where(F.to_timestamp("timestamp") <= F.to_timestamp(F.lit(moment))).agg(F.max("position")).first()[0]
        return found or 0

    def diff(self, start: int, end: int) -> DataFrame:
        """(op, quad): the net of (start, end], or its inverse if end is before start."""
        if start <= end:
            delta = self.changes(start, end)
            return delta.select("op", *QUAD) if end - start == 1 else net(delta)  # one commit's is exact
        return self.diff(end, start).withColumn("op", F.when(F.col("op") == "+", "-").otherwise("+"))

    def extents(self) -> DataFrame:
        """(quad, valid_from, valid_to): when each quad held; valid_to is NULL where it still does."""
        later = Window.partitionBy(*QUAD).orderBy("position")
        rows = self.changes().withColumn("valid_to", F.lead("position").over(later))
        return rows.where("op = '+'").select(*QUAD, F.col("position").alias("valid_from"), "valid_to")

    def graph_versions(self) -> DataFrame:
        """(g, position): the last commit that touched each graph."""
        return self.commits().select("position", F.explode("graphs").alias("g")).groupBy("g").agg(F.max("position").alias("position"))

    # --- writes ----------------------------------------------------------------------

    def apply(self, operations: DataFrame, *, expected: int | None = None, scope: list[str] | None = None, writable: list[str] | None = None, kind: str = "data", agent: str = "", cause: str = "", key: str = "", attachments: tuple[str, ...] = ()) -> Outcome:
        """Commit operations (op, quad[, seq]); of several on one quad the last by ``seq`` counts.

        What is stored is the effective delta: assertions of quads that are absent,
        retractions of quads that are present.  With ``expected`` the commit fails if a later
        one touched ``scope`` (any graph without it).  A ``key`` that a recent commit has is
        answered by that commit.
        """
        head = self.head()
        if key:
            found = self.commits().where((F.col("key") == key) & (F.col("position") > head - self.key_window)).agg(F.max("position")).first()[0]
            if found:
                return Outcome("repeated", found)
        if expected is not None and expected < head:
            touched = self.commits().where(F.col("position") > expected)
            if scope is not None:
                touched = touched.where(F.arrays_overlap("graphs", F.array(*map(F.lit, scope))) | (F.col("kind") != "data"))
            if not touched.isEmpty():
                raise Conflict(f"position {expected} is behind {head}")
        state = self.quads(head)
        last = last_operations(operations)
        effective = _without(last.where("op = '+'"), state).unionByName(_within(last.where("op = '-'"), state)).select("op", *QUAD)
        # a folder of its own: two writers may both write for this position before one wins it
        part = uuid.uuid4().hex
        name = f"changes/pos={head + 1}/part={part}"
        folder = f"{self.path}/{name}"
        effective.write.mode("overwrite").parquet(folder)
        delta = self.spark.read.schema("op string, s string, p string, o string, g string").parquet(folder)
        groups = delta.groupBy("op", "g").agg(F.count("*").alias("n")).collect()
        counts = {op: sum(r["n"] for r in groups if r["op"] == op) for op in {r["op"] for r in groups}}
        if not counts and kind == "data":
            self._fs()[1].delete(self._path(name), True)
            return Outcome("no change", head)
        graphs = list({r["g"] or DEFAULT_GRAPH for r in groups})
        if writable is not None and set(graphs) - set(writable):
            raise NotWritable(", ".join(sorted(set(graphs) - set(writable))))
        if kind == "data":
            after = overlay(state, delta.where("op = '+'"), delta.where("op = '-'"))
            for validator in self.validators:
                verdict = validator(after, delta)
                if verdict:
                    raise Rejected(verdict)
        before = self.commit(head)
        now = self.clock().isoformat()
        record = Commit(head + 1, kind, max(now, before.timestamp) if before else now, agent, cause, key, tuple(attachments), tuple(sorted(graphs)), counts.get("+", 0), counts.get("-", 0), content_hash(delta), _digest(before), part)
        if not self._publish(f"commits/{head + 1:012d}.json", json.dumps(vars(record), sort_keys=True)):
            self._fs()[1].delete(self._path(name), True)
            raise Conflict(f"position {head + 1} was taken")
        return Outcome("committed", head + 1)

    def insert(self, quads: DataFrame, **options) -> Outcome:
        return self.apply(quads.select(F.lit("+").alias("op"), *QUAD), **options)

    def delete(self, quads: DataFrame, **options) -> Outcome:
        return self.apply(quads.select(F.lit("-").alias("op"), *QUAD), **options)

    def checkpoint(self, position: int | None = None) -> int:
        position = self.head() if position is None else position
        self.quads(position).repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o").write.mode("overwrite").parquet(f"{self.path}/snapshots/pos={position}")
        return position

    def drop_checkpoint(self, position: int) -> None:
        self._fs()[1].delete(self._path(f"snapshots/pos={position}"), True)

    def verify(self) -> list[int]:
        """Positions whose content or link to the commit before does not match its record."""
        bad, before = [], None
        for position in range(1, self.head() + 1):
            record = self.commit(position)
            if record.previous != _digest(before) or record.content != content_hash(self.changes(position - 1, position)):
                bad.append(position)
            before = record
        return bad


def content_hash(delta: DataFrame) -> str:
    """An order-free digest of a delta: the sum of its lines' SHA-256 values, so that no task sorts them all.

    It is summed in eight parts of 32 bits: each line is hashed once, its digits are read 64 bits at a time,
    and the sums are whole numbers within a task, where fewer than 2^31 lines cannot overflow them.
    """
    line = F.concat_ws(" ", "op", "s", "p", "o", F.coalesce("g", F.lit("")))
    words = [F.conv(F.substring("hash", 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"w{i}") for i in range(4)]
    halves = [half(F.col(f"w{i}")) for i in range(4) for half in (lambda w: F.shiftrightunsigned(w, 32), lambda w: w.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = delta.select(F.sha2(line, 256).alias("hash")).select(*words)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"x{i}") for i, h in enumerate(halves)])
    sums = tasks.agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in tasks.columns if c != "task"]).first()
    return hashlib.sha256("|".join(str(x or 0) for x in sums).encode()).hexdigest()


def _digest(commit: Commit | None) -> str:
    return hashlib.sha256(json.dumps(vars(commit), sort_keys=True).encode()).hexdigest() if commit else ""

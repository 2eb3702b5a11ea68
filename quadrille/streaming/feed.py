"""Following a store: change feed, its text format, and projections kept up by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.sources.rdf import parse_nquad
from quadrille.store import QUAD, Store

COMMITS = "position long, kind string, timestamp string, agent string, cause string, key string, attachments array<string>, graphs array<string>, asserted long, retracted long, content string, previous string"


def bounded(store: Store, after: int = 0, to: int | None = None, *, from_time: str | None = None, to_time: str | None = None, graphs: list[str] | None = None, pattern: tuple[str | None, str | None, str | None] | None = None) -> DataFrame:
    """(position, kind, timestamp, op, quad) of a range of commits.

    A start time means the first commit at or after it, an end time the last at or before.
    Filters cut the changes; commits without changes left vanish, but those of other kinds
    than data stay, with a NULL quad.
    """
    commits = store.commits()
    if from_time is not None:
        first = commits.where(F.to_timestamp("timestamp") >= F.to_timestamp(F.lit(from_time))).agg(F.min("position")).first()[0]
        after = max(after, (first or store.head() + 1) - 1)
    if to_time is not None:
        to = min(store.head() if to is None else to, store.position_at(to_time))
    to = store.head() if to is None else to
    return cut_changes(commits.where((F.col("position") > after) & (F.col("position") <= to)), store.changes(after, to), graphs, pattern)


def cut_changes(commits: DataFrame, changes: DataFrame, graphs: list[str] | None, pattern: tuple[str | None, str | None, str | None] | None) -> DataFrame:
    if graphs is not None:
        changes = changes.where(F.coalesce("g", F.lit("DEFAULT")).isin(graphs))
    for column, term in zip("spo", pattern or ()):
        if term is not None:
            changes = changes.where(F.col(column) == term)
    joined = commits.select("position", "kind", "timestamp", "agent", "cause", "attachments").join(changes, "position", "left")
    return joined.where("op is not null or kind != 'data'")


def follow(store: Store, handler: Callable[[DataFrame, int], None], checkpoint: str, *, graphs: list[str] | None = None, pattern: tuple[str | None, str | None, str | None] | None = None, once: bool = False) -> StreamingQuery:
    """A streaming query that hands each batch of new commits, with their changes, to ``handler``.

    At least once, resumed by the query's own checkpoint: a handler that keeps the last
    position with its state has each commit's effect exactly once.
    """

    def batch(commits: DataFrame, number: int) -> None:
        ends = commits.agg(F.min("position"), F.max("position")).first()
        if ends[0] is not None:
            handler(cut_changes(commits, store.changes(ends[0] - 1, ends[1]), graphs, pattern), number)

    stream = store.spark.readStream.schema(COMMITS).json(f"{store.path}/commits")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass
class Projection:
    """A fold over the log whose state moves only forward: ``fold(state, changes)`` gives the next state."""

    store: Store
    path: str
    fold: Callable[[DataFrame | None, DataFrame], DataFrame]
    position: int = field(default=0, init=False)

    def update(self, to: int | None = None) -> DataFrame:
        """Bring the state to a position; commits up to the stored one are not folded again."""
        spark = self.store.spark
        mark = f"{self.path}/position"
        fs = self.store._fs()[1]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
        at = max((r["position"] for r in spark.read.json(mark).collect()), default=0) if fs.exists(path) else 0
        to = self.store.head() if to is None else to
        if to > at:
            state = spark.read.parquet(f"{self.path}/state-{at}") if at else None
            self.fold(state, self.store.changes(at, to)).write.mode("overwrite").parquet(f"{self.path}/state-{to}")
            spark.createDataFrame([(to,)], "position long").coalesce(1).write.mode("append").json(mark)
            at = to
        self.position = at
        return spark.read.parquet(f"{self.path}/state-{at}")


def to_text(feed: DataFrame) -> DataFrame:
    """(position, value): the text of each commit, in the line format of the feed.

    ``commit <position> <kind> <timestamp>``, then lines for agent, cause and
    attachments, then ``+`` or ``-`` and a quad for each change, then an empty line.
    """
    line = F.concat(F.col("op"), F.lit(" "), F.concat_ws(" ", *QUAD), F.lit(" ."))
    one = feed.withColumn("line", line).groupBy("position", "kind", "timestamp", "agent", "cause", "attachments").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    head = F.array(F.concat_ws(" ", F.lit("commit"), F.col("position").cast("string"), "kind", "timestamp"))
    optional = [F.when(F.col(c) != "", F.concat(F.lit(f"{c} "), F.col(c))) for c in ("agent", "cause")]
    marks = F.transform("attachments", lambda a: F.concat(F.lit("attachment "), a))
    lines = F.concat(head, F.filter(F.array(*optional), lambda x: x.isNotNull()), marks, "lines", F.array(F.lit("")))
    return one.select("position", F.array_join(lines, "\n").alias("value"))


def parse_text(text: str) -> Iterator[dict]:
    """The commits of a feed's text: position, kind, timestamp, agent, cause, attachments, changes."""
    for block in text.split("\n\n"):
        if not block.strip():
            continue
        commit: dict = {"agent": "", "cause": "", "attachments": [], "changes": []}
        for line in filter(None, block.split("\n")):
            word, _, rest = line.partition(" ")
            if word == "commit":
                position, kind, timestamp = rest.split(" ")
                commit |= {"position": int(position), "kind": kind, "timestamp": timestamp}
            elif word in ("agent", "cause"):
                commit[word] = rest
            elif word == "attachment":
                commit["attachments"].append(rest)
            elif word in "+-":
                commit["changes"].append((word, *parse_nquad(rest)))
            else:
                raise ValueError(f"unknown line: {line!r}")
        yield commit


def to_events(feed: DataFrame) -> DataFrame:
    """(id, data): a server-sent event for each commit."""
    return to_text(feed).select(F.col("position").alias("id"), F.concat(F.lit("id: "), F.col("position").cast("string"), F.lit("\ndata: "), F.replace("value", F.lit("\n"), F.lit("\ndata: "))).alias("data"))



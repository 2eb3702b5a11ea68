"""Near-duplicate vectors by a robust-pruned flat graph (operator 4).

Centroids fitted on a bounded sample cut the vectors into shards that overlap: each
vector goes to its ``overlap`` nearest centroids.  A shard of more than ``BLOCK``
vectors is cut into blocks by a hash, so no task holds more than two blocks.  In each
block every vector takes neighbours from its nearest ones and some at random, pruned so
that no neighbour is much nearer to another one (robust pruning); the adjacency lists
that a vector has from its shards are united.  Then all vectors of a shard search each
of the shard's blocks: a greedy best-first search from medoids, which goes on through
all vectors found within a slightly wider range.  Cosines in double precision decide.

Equal vectors are one node with a count.  A pair is counted only in the smallest shard
that both share, and links of a unit of work leave it as counts and as a spanning
forest, so a group of n near copies is never written out as n * n pairs.

``audit`` compares a bounded sample of vectors with all others by brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Workspace
from quadrille.llm.components import connected_components

THRESHOLD, SLACK = 0.9, 0.04
SAMPLE, SHARD, BLOCK, CENTROIDS = 16_384, 512, 1024, 1024
OVERLAP, NEAREST, DEGREE, RANDOM, ALPHA = 3, 40, 24, 12, 1.2
BEAM, MEDOIDS, QUERIES = 16, 12, 128
AUDIT = 256


def prepare(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Per row: id, dims (0 where the vector links with nothing), two digests, the unit vector as doubles.

    Digests are of the components as doubles, so equal vectors have equal digests;
    negative zero counts as zero.
    """

    # keys stay out of Python, so a null key can't change the kind of the others
    @F.pandas_udf("struct<dims int, a long, b long, unit binary>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            v = np.array([], dtype=np.float64) if value is None else np.asarray([np.nan if x is None else x for x in value], dtype=np.float64) + 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(v).max() if len(v) else 0.0
                good = len(v) > 0 and np.isfinite(v).all() and scale > 0
            if good:
                a, b = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), dtype="<i8").tolist()
                unit = v / scale
                rows.append((len(v), a, b, (unit / np.sqrt(unit @ unit)).tobytes()))
            else:
                rows.append((0, 0, 0, None))
        return pd.DataFrame(rows, columns=["dims", "a", "b", "unit"])

    return vectors.select(F.col(key).cast("long").alias("id"), run(F.col(vector)).alias("_v")).select("id", "_v.*")


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def build(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Adjacency (row numbers, -1 for none) of the vectors of one block, both directions of every edge."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int64)
    rng = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    parts = []
    for low in range(0, n, 64):
        rows = np.arange(low, min(n, low + 64))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        drawn = rng.integers(n, size=(len(rows), min(RANDOM, n)))
        drawn[drawn == rows[:, None]] = -1
        drawn[(drawn[:, :, None] == top[:, None, :]).any(axis=2)] = -1
        kept = np.concatenate([top, drawn], axis=1)
        parts.append(robust_prune(x, rows, kept))
    forward = np.vstack(parts)
    # reverse edges, as many as fit in twice the degree
    a = np.repeat(np.arange(n), forward.shape[1])
    b = forward.ravel()
    a, b = b[b >= 0], a[b >= 0]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    back = np.full((n, DEGREE), -1, dtype=np.int64)
    fits = place < DEGREE
    back[a[fits], place[fits]] = b[fits]
    return np.concatenate([forward, back], axis=1)


def robust_prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each of ``rows`` at most ``degree`` of its candidates (row numbers of x, -1 for none).

    The nearest remaining candidate is taken; candidates that it is ``alpha`` times nearer
    to than the row itself go.
    """
    local = x[np.maximum(candidates, 0)]
    far = np.where(candidates < 0, np.inf, 1 - np.einsum("nd,nmd->nm", x[rows], local))
    between = 1 - np.matmul(local, local.transpose(0, 2, 1))
    alive, chosen = np.isfinite(far), np.full((len(rows), degree), -1, dtype=np.int64)
    at = np.arange(len(rows))
    for step in range(degree):
        best = np.where(alive, far, np.inf).argmin(axis=1)
        some = alive[at, best]
        if not some.any():
            break
        chosen[some, step] = candidates[at, best][some]
        alive &= ~((alpha * between[at, best] <= far) & some[:, None])
        alive[at, best] = False
    return chosen


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """Row numbers of the vectors nearest to the centres of a few clusters."""
    return np.unique((x @ k_means(x, count, rounds=3).T).argmax(axis=0))


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, entries: np.ndarray, own: np.ndarray, least: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, row numbers) of the pairs found with cosine >= least, a batch of queries at a time.

    ``own`` is the row of each query in x, or -1; it is an entry too.
    """
    n = len(x)
    for low in range(0, len(queries), QUERIES):
        q = queries[low : low + QUERIES]
        at = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        sims = np.full((len(q), n), -2.0)
        seen[:, entries] = True
        sims[:, entries] = q @ x[entries].T
        mine = own[low : low + QUERIES]
        has = mine >= 0
        seen[at[has], mine[has]] = True
        sims[at[has], mine[has]] = np.einsum("qd,qd->q", q[has], x[mine[has]])
        expanded = np.zeros((len(q), n), dtype=bool)
        for _ in range(4 * beam):  # best first, until the beam holds nothing unexpanded
            width = min(beam, n)
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            value = np.where(expanded[at[:, None], top], -3.0, sims[at[:, None], top])
            best = value.argmax(axis=1)
            live = value[at, best] > -1.5
            if not live.any():
                break
            node = top[at, best][live]
            expanded[at[live], node] = True
            _visit(q, x, graph, at[live], node, seen, sims)
        while True:  # all that lies in the wider range
            rows, nodes = np.nonzero((sims >= least - SLACK) & ~expanded)
            if not len(rows):
                break
            expanded[rows, nodes] = True
            _visit(q, x, graph, rows, nodes, seen, sims)
        rows, nodes = np.nonzero(sims >= least)
        yield rows + low, nodes


def _visit(q: np.ndarray, x: np.ndarray, graph: np.ndarray, rows: np.ndarray, nodes: np.ndarray, seen: np.ndarray, sims: np.ndarray) -> None:
    """Compare queries with the unseen neighbours of nodes."""
    next_rows, next_nodes = np.repeat(rows, graph.shape[1]), graph[nodes].ravel()
    fresh = next_nodes >= 0
    next_rows, next_nodes = next_rows[fresh], next_nodes[fresh]
    fresh = ~seen[next_rows, next_nodes]
    next_rows, next_nodes = next_rows[fresh], next_nodes[fresh]
    if len(next_rows):
        pairs = np.unique(next_rows * len(x) + next_nodes)
        next_rows, next_nodes = np.divmod(pairs, len(x))
        seen[next_rows, next_nodes] = True
        for low in range(0, len(pairs), 1 << 16):
            a, b = next_rows[low : low + (1 << 16)], next_nodes[low : low + (1 << 16)]
            sims[a, b] = np.einsum("pd,pd->p", q[a], x[b])


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join labels which were apart; ``labels`` is brought up to date.  The pairs are grouped by a."""
    joined = []
    starts = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0])) if len(a) else []
    for low, high in zip(starts, [*starts[1:], len(a)]):
        one, others = a[low], b[low:high]
        found, first = np.unique(labels[others], return_index=True)
        apart = found != labels[one]
        if apart.any():
            joined += [(int(one), int(x)) for x in others[first[apart]]]
            labels[np.isin(labels, found[apart])] = labels[one]
    return joined


def near_vectors(vectors: DataFrame, work: Workspace, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links, component_id, kept, audit_recall.

    n_links counts the other rows with cosine >= ``threshold`` that were found;
    component_id is the smallest key reachable by links.  A vector that is null, empty,
    zero or has null or non-finite components links with nothing, nor do vectors of different
    lengths with each other.  Rows with a null key link with nothing, have a null
    component and are kept.  Rows of equal keys and vectors are counted as links of each
    other; rows of equal keys and different vectors are one node.  audit_recall is the
    part of the links of at most AUDIT sampled vectors that the search found, measured
    against all vectors (1.0 where they have none).  An empty table gives an empty table;
    other columns are not read.
    """
    rows = work.save(prepare(vectors, key, vector), "rows")
    some = rows.where("dims > 0 and id is not null")
    classes = work.save(some.groupBy("dims", "a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = some.join(classes, ["dims", "a", "b"]).where("id = rep").groupBy("rep").agg(F.first("unit").alias("unit"), F.first("dims").alias("dims"), F.first("copies").alias("copies"))
    reps = work.save(reps, "reps")
    sizes = {r["dims"]: r["n"] for r in reps.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    centres: dict[int, np.ndarray] = {}
    for dims, n in sizes.items():  # a sample of SAMPLE vectors at most, for each length of vectors
        k = max(1, min(CENTROIDS, math.ceil(n / SHARD)))
        drawn = reps.where(F.col("dims") == dims).orderBy(F.xxhash64("rep")).limit(min(SAMPLE, 32 * k)).select("unit").collect()
        centres[dims] = k_means(_matrix([bytes(r["unit"]) for r in drawn]), k)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shards = np.empty(len(frame), dtype=object)
            for dims in frame["dims"].unique():
                at = np.flatnonzero(frame["dims"] == dims)
                c = centres.get(int(dims))  # lengths beyond the 64 most common have one shard each
                if c is None:
                    found = np.zeros((len(at), 1), dtype=np.int64)
                else:
                    sims = _matrix(frame["unit"].iloc[at].tolist()) @ c.T
                    width = min(overlap, len(c))
                    found = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                for i, f in zip(at, found):
                    shards[i] = sorted((f + (int(dims) << 16)).tolist())
            yield frame.assign(shards=shards)

    placed = work.save(reps.mapInPandas(assign, "rep long, unit binary, dims int, copies long, shards array<long>"), "placed")
    flat = placed.select("rep", "unit", "copies", "shards", F.explode("shards").alias("shard"))
    held = flat.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = flat.join(held, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = work.save(dealt, "dealt")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["rep"].to_numpy()
        graph = build(_matrix(frame["unit"].tolist()))
        return pd.DataFrame({"rep": ids, "near": [ids[g[g >= 0]] for g in graph]})

    lists = dealt.groupBy("shard", "block").applyInPandas(link, "rep long, near array<long>")
    united = work.save(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = dealt.join(united, "rep").withColumn("other", others)
    units = units.select("rep", "unit", "copies", "shards", "near", "shard", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["block"].to_numpy()
        i, j, shard = int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), int(frame["shard"].iloc[0])
        ids, copies, x = frame["rep"].to_numpy(), frame["copies"].to_numpy(), _matrix(frame["unit"].tolist())
        asks, holds = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if not len(asks) or not len(holds):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        order = np.argsort(ids[holds])
        holds = holds[order]
        names = ids[holds]
        lists = [np.asarray(frame["near"].iloc[h], dtype=np.int64) for h in holds]
        width = max(1, *map(len, lists))
        graph = np.full((len(holds), width), -1, dtype=np.int64)
        for row, near in enumerate(lists):
            at = np.minimum(np.searchsorted(names, near), len(names) - 1)
            at = at[names[at] == near]
            graph[row, : len(at)] = at
        own = np.full(len(asks), -1, dtype=np.int64)
        if i == j:
            own = np.searchsorted(names, ids[asks])
        width = max(map(len, frame["shards"]))
        homes = np.array([[*s, *[-1] * (width - len(s))] for s in frame["shards"]], dtype=np.int64)
        links = np.zeros(len(frame), dtype=np.int64)
        labels = np.arange(len(frame))
        edges = []
        for a, b in range_search(x[asks], x[holds], graph, medoids(x[holds]), own, threshold):
            a, b = asks[a], holds[b]
            a, b = a[a != b], b[a != b]
            edges += _forest(labels, a, b)
            # the pair belongs to the smallest shard of both
            mine, its = homes[a], homes[b]
            common = np.where((mine[:, :, None] == its[:, None, :]).any(axis=2) & (mine >= 0), mine, np.iinfo(np.int64).max).min(axis=1)
            a, b = a[common == shard], b[common == shard]
            np.add.at(links, a, copies[b])
            if i != j:
                np.add.at(links, b, copies[a])
        counted = np.flatnonzero(links)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids[counted], ids[e[:, 0]]]), "b": np.concatenate([np.full(len(counted), -1), ids[e[:, 1]]]), "n": np.concatenate([links[counted], np.full(len(e), -1)])})

    found = work.save(units.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long, n long"), "found")
    links = work.save(found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("found")), "links")
    parts = connected_components(found.where("n < 0").select("a", "b"), work)
    recall = audit(placed, links, threshold)

    own = rows.join(classes, ["dims", "a", "b"], "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.col("rep")))
    out = own.join(links, "rep", "left").join(parts, own["rep"] == parts["node"], "left")
    n_links = F.when(F.col("rep").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("found", F.lit(0)))
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(key), n_links.cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )


def audit(placed: DataFrame, links: DataFrame, threshold: float, most: int = AUDIT) -> float:
    """Links found of ``most`` vectors, drawn by a hash, over their links by brute force against all vectors."""
    drawn = placed.orderBy(F.xxhash64(F.lit(11), F.col("rep"))).limit(most).join(links, "rep", "left").select("rep", "unit", "dims", F.coalesce("found", F.lit(0)).alias("found")).collect()
    by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {r["dims"] for r in drawn}:
        mine = [r for r in drawn if r["dims"] == dims]
        by_dims[dims] = (np.array([r["rep"] for r in mine]), _matrix([bytes(r["unit"]) for r in mine]))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims in frame["dims"].unique():
                if int(dims) in by_dims:
                    part = frame[frame["dims"] == dims]
                    names, queries = by_dims[int(dims)]
                    near = (queries @ _matrix(part["unit"].tolist()).T >= threshold) & (names[:, None] != part["rep"].to_numpy()[None, :])
                    yield pd.DataFrame({"rep": names, "n": near @ part["copies"].to_numpy()})

    true = {r["rep"]: r["n"] for r in placed.mapInPandas(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    total = sum(true.values())
    return float(sum(min(r["found"], true.get(r["rep"], 0)) for r in drawn) / total) if total else 1.0

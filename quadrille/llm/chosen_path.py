"""Near-duplicate documents by a chosen-path set similarity join (operator 10).

A document is the set of its distinct five-word shingles; its signature holds the
smallest hash of the set under each of ``COORDINATES`` hash functions.  Each of several
independent trees starts with all documents in one node.  A node picks two coordinates at
random and sends every document to the child named by the document's minwise token
there, so a pair of similarity s meets in each of the two children with probability s.
Nodes of few documents are leaves; so are nodes that hardly shrink, as their documents
are alike.  At s = 0.75 a tree of any depth keeps a pair together in some leaf with
probability at least 0.88 (the survival of a branching process with two children that
live with probability s), so three trees miss at most 2 in 1000 such pairs, and far
fewer of more alike ones.

Leaves are compared exhaustively, except that pairs already known to be in one component
need no comparison: first each leaf's smallest document meets the rest, which settles
groups of copies in as many pairs as they have members.  In what is left of a leaf the
documents outside its largest component meet all others, in blocks of bounded size.  A
first pass over signatures names the documents that may have a link; a second one compares
their full sets where they meet, and only links that join components leave it, so a large
group beside documents that are almost like it is never written out as pairs.
Signatures only pre-filter by a wide margin; every link is confirmed on full sets.

``audit_recall`` compares the signatures of AUDIT documents with all others, confirms
those pairs on full sets and tells which part of them the join has in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Workspace
from quadrille.llm.components import connected_components

WIDTH, THRESHOLD = 5, 0.75
COORDINATES, TREES, DEPTH, LEAF, AUDIT = 256, 3, 14, 256, 32
#: Documents of a block where signatures meet, and where full sets do.
BLOCK, SET_BLOCK = 2048, 256
#: A child of at least this part of its parent counts as not shrinking.
DENSE = 0.7
#: Bits of a coordinate in the short signature; those of unlike documents agree in one case of 16.
SHORT_BITS = 4
_AGREEING = THRESHOLD + (1 - THRESHOLD) * 0.5**SHORT_BITS
#: Pairs whose short signatures agree in fewer coordinates are not confirmed: what the threshold leads to, less 5 standard errors.
LEAST_AGREEING = COORDINATES * (_AGREEING - 5 * (_AGREEING * (1 - _AGREEING) / COORDINATES) ** 0.5)
_REMEMBERED = 100_000
_ODD = np.random.default_rng(20240229).integers(1 << 62, size=COORDINATES + WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  A text of
    fewer words than ``width`` is one shingle; one without words has none.
    """
    words = (text or "").encode().lower().split()  # bytes: only ASCII is lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(ids))
    found = np.full(len(ids) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        found += ids[i : len(ids) - span + 1 + i] * _ODD[COORDINATES + i]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return np.unique(found)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For every coordinate 16 bits that name the smallest product of a shingle with its odd factor: all low bytes, then all high bytes."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _ODD[None, :COORDINATES]).min(axis=0), out=low)
    return (low * _MIX >> np.uint64(48)).astype("<u2").view(np.uint8).reshape(-1, 2).T.copy()


def short(sig: np.ndarray) -> np.ndarray:
    """SHORT_BITS bits of each coordinate of a signature, two coordinates a byte."""
    low = sig[0].reshape(-1, 2) & 0x0F
    return low[:, 0] | low[:, 1] << 4


def _shorts(packed) -> np.ndarray:
    """A row of 64-bit words for each packed short signature."""
    return np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(-1, COORDINATES * SHORT_BITS // 64)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates the rows of x and y agree."""
    differ = x ^ y
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    return COORDINATES - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: doc, n_shingles, two digests of the set, the packed signature and the short one."""

    # keys stay out of Python, so a null key can't change the kind of the others
    @F.pandas_udf("struct<n_shingles long, set_a long, set_b long, sig binary, short binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            shingles = shingle_set(value)
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            sig = signature(shingles)
            rows.append((len(shingles), *np.frombuffer(digest, dtype="<i8").tolist(), sig.tobytes(), short(sig).tobytes()))
        return pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "sig", "short"])

    return docs.select(F.col(key).cast("long").alias("doc"), run(F.col(text)).alias("_s")).select("doc", "_s.*")


def _children(node: str | Column, seed: int) -> Column:
    """The two children of a node that a document with signature ``sig`` goes to."""
    first = F.pmod(F.xxhash64(F.lit(seed), node), F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(F.lit(seed + 1), node), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    return F.array(*[F.xxhash64(node, i, F.substring("sig", (i + 1).cast("int"), F.lit(1)), F.substring("sig", (i + 1 + COORDINATES).cast("int"), F.lit(1))) for i in (first, second)])


def leaves(reps: DataFrame, work: Workspace, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """(node, rep, size) of every leaf of at least two documents; ``reps`` has rep and sig."""
    found: DataFrame | None = None
    roots = F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(trees)])
    step = reps.select("rep", "sig", F.explode(roots).alias("node"), F.lit(float("inf")).alias("size"))
    for level in range(depth):
        grown = work.save(step.select(F.explode(_children("node", 2 * level)).alias("node"), "rep", F.col("size").alias("above")), f"level-{level}")
        sizes = grown.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        done = (F.col("size") <= leaf) | (F.col("size") >= DENSE * F.col("above")) | F.lit(level == depth - 1)
        kept = work.save(grown.join(sizes, "node").select("node", "rep", "size", done.alias("done")), f"kept-{level}")
        work.drop(f"level-{level}")
        ended = kept.where("done").select("node", "rep", "size")
        found = ended if found is None else found.unionByName(ended)
        if kept.where("not done").isEmpty():
            break
        step = kept.where("not done").select("node", "rep", "size").join(reps.select("rep", "sig"), "rep")
    return found


def _agreeing(pairs: DataFrame, shorts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough; ``shorts`` has rep and short."""
    one = shorts.select(F.col("rep").alias("a"), F.col("short").alias("short_a"))
    two = shorts.select(F.col("rep").alias("b"), F.col("short").alias("short_b"))

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(agreeing(_shorts(x), _shorts(y)) >= LEAST_AGREEING)

    return pairs.join(one, "a").join(two, "b").where(agree("short_a", "short_b")).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents in ``wanted`` (rep), from their whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"rep": frame["rep"], "shingles": [shingle_set(t).tobytes() for t in frame["_text"]]})

    return docs.join(wanted, "rep", "left_semi").mapInPandas(run, "rep long, shingles binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 100 * threshold * union."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    percent = round(100 * threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["set_a"], frame["set_b"]):
                keep.append(alike(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            yield frame.loc[keep, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the leaves that meet more than one component, with the component as label."""
    labels = parts.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    named = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("node")
    return named.join(mixed, "node", "left_semi")


def _units(members: DataFrame, block: int) -> DataFrame:
    """Members (node, rep, label) dealt into units of work (node, i, j), with the side each is on.

    A pair needs a look if its labels differ, so at least one of the two is outside the
    leaf's largest component.  Documents outside it and those inside are cut into blocks;
    every block of the former meets every block of either kind once.  A unit holds two
    blocks, and a few strays in a large leaf copy its other members only as often as there
    are blocks of strays.  A leaf of no more than a block is one unit, with all on one side.
    """
    sizes = members.groupBy("node", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("node").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("node", F.col("top.label").alias("major"), F.col("top.n").alias("inside"), (F.col("all") - F.col("top.n")).alias("outside"))
    fits = F.col("inside") + F.col("outside") <= block
    outer, inner = F.when(fits, F.lit(1)).otherwise(F.ceil(F.col("outside") / block)), F.when(fits, F.lit(0)).otherwise(F.ceil(F.col("inside") / block))
    is_outer = fits | (F.col("label") != F.col("major"))
    rows = members.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(is_outer, outer).otherwise(inner)))
    number = lambda low, high: F.filter(F.sequence(F.least(low, high), high), lambda x: x >= low)
    zero = F.lit(0).cast("long")
    # as the one who asks it meets later blocks of outsiders and all blocks of insiders; earlier outsiders ask it
    asks = F.transform(number(F.col("own"), outer + inner - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    asked = F.transform(F.filter(F.sequence(zero, outer - 1), lambda i: i < F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    held = F.transform(F.sequence(zero, outer - 1), lambda i: F.struct(i.alias("i"), (outer + F.col("own")).alias("j"), F.lit(1).alias("side")))
    return rows.select("node", "rep", "label", F.explode(F.when(is_outer, F.concat(asks, asked)).otherwise(held)).alias("u")).select("node", "rep", "label", "u.*")


def _unit_frames(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames with the row ranges of the whole units in them, from frames sorted by (node, i, j)."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        whole = pd.concat([*held, frame]) if held else frame
        names = whole[["node", "i", "j"]].to_numpy()
        ends = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield whole.iloc[:last], list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        held = [whole.iloc[last:]]
    if held:
        yield held[0], [(0, len(held[0]))]


def _candidates(sig: np.ndarray, label: np.ndarray, side: np.ndarray, inside: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each document on side 0 the documents of the unit that it may link with, of other labels as they are then."""
    others = np.flatnonzero(side == 1)
    for k in np.flatnonzero(side == 0).tolist():
        among = np.arange(k + 1, len(side)) if inside else others
        among = among[label[among] != label[k]]
        if len(among):
            hit = among[agreeing(sig[among], sig[k]) >= LEAST_AGREEING]
            if len(hit):
                yield k, hit


def _active(units: DataFrame, shorts: DataFrame) -> DataFrame:
    """(node, rep) of the members that have a candidate in some unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ranges in _unit_frames(frames):
            sig, (node, rep, label, side, i, j) = _shorts(frame["short"]), (frame[c].to_numpy() for c in ("node", "rep", "label", "side", "i", "j"))
            met = np.zeros(len(frame), dtype=bool)
            for low, high in ranges:
                for k, hit in _candidates(sig[low:high], label[low:high], side[low:high], i[low] == j[low]):
                    met[low + k] = met[low + hit] = True
            yield pd.DataFrame({"node": node[met], "rep": rep[met]})

    rows = units.join(shorts, "rep").select("node", "rep", "label", "side", "i", "j", "short")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInPandas(run, "node long, rep long").distinct()


def _joining(units: DataFrame, shorts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join components of a unit, confirmed on full sets."""
    percent = round(100 * threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ranges in _unit_frames(frames):
            sig, (rep, label, side, i, j) = _shorts(frame["short"]), (frame[c].to_numpy() for c in ("rep", "label", "side", "i", "j"))
            shingles = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
            found = []
            for low, high in ranges:
                now = label[low:high].copy()
                for k, hit in _candidates(sig[low:high], now, side[low:high], i[low] == j[low]):
                    for h in hit.tolist():
                        if now[h] != now[k] and alike(shingles[low + k], shingles[low + h], percent):
                            found.append((rep[low + k], rep[low + h]))
                            now[now == now[h]] = now[k]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = units.join(shorts, "rep").join(sets, "rep").select("node", "rep", "label", "side", "i", "j", "short", "shingles")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInPandas(run, "a long, b long")


def _audit_pairs(shorts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of ``most`` documents, drawn by a hash, with all whose signatures agree enough."""
    drawn = shorts.orderBy(F.xxhash64(F.lit(11), F.col("rep"))).limit(most).collect()
    names, asked = np.array([r["rep"] for r in drawn], dtype=np.int64), _shorts([bytes(r["short"]) for r in drawn])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rep, sig = frame["rep"].to_numpy(), _shorts(frame["short"])
            for name, one in zip(names, asked):
                hit = rep[(agreeing(sig, one) >= LEAST_AGREEING) & (rep != name)]
                yield pd.DataFrame({"a": np.full(len(hit), name), "b": hit})

    return shorts.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, set_block: int = SET_BLOCK, audit: int = AUDIT) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept, audit_recall.

    Rows link if they share at least ``threshold`` of their joint shingles; component_id
    is the smallest key reachable, kept marks the row whose key that is.  Null, empty and
    white texts have no shingles and link with nothing.  Rows of equal keys count as one
    document; a null key links with nothing and is kept, with a null component.  Texts of
    any length are used whole.  An empty table gives an empty table; columns other than
    key and text are not read.  ``threshold`` should not be below 0.75, for which the
    margins are chosen.  audit_recall is the part of the links of ``audit`` documents,
    compared with all, that are in one component (1.0 where they have none; null if
    ``audit`` is 0).
    """
    sketches = work.save(sketch(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = sketches.where("n_shingles > 0 and doc is not null")
    classes = work.save(some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc", "row")).alias("least")).select("set_a", "set_b", "least.*"), "classes")
    # one row of each representative, chosen by numbers alone: signatures are moved at most once
    rows = work.save(classes.groupBy(F.col("doc").alias("rep")).agg(F.min("row").alias("row")), "chosen")
    reps = work.save(some.join(rows, "row").select("rep", "sig", "short"), "reps")
    classes = classes.select("set_a", "set_b", F.col("doc").alias("rep"))
    sketches = work.save(sketches.select("doc", "n_shingles", "set_a", "set_b"), "sizes")
    work.drop("sketches")
    shorts = work.save(reps.select("rep", "short"), "shorts")
    members = work.save(leaves(reps.select("rep", "sig"), work, trees=trees, leaf=leaf), "members")
    work.drop("reps")
    for level in range(DEPTH):
        work.drop(f"kept-{level}")
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("_text")).where("rep is not null")

    hubs = members.groupBy("node").agg(F.min("rep").alias("hub"))
    pairs = members.join(hubs, "node").where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = work.save(_agreeing(pairs, shorts), "pairs-hub")
    asked = work.save(_audit_pairs(shorts, audit), "pairs-audit") if audit else pairs.limit(0)
    # the wanted are tables, so that their size is known before texts would be shuffled to them
    wanted = work.save(pairs.union(asked).select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted-hub")
    sets = work.save(_sets(texts, wanted), "sets-hub")
    edges = work.save(_confirmed(pairs, sets, threshold), "edges-hub")
    true = work.save(_confirmed(asked, sets, threshold), "edges-audit") if audit else None
    mixed = work.save(_labelled(members, connected_components(edges, work, "parts-hub")), "mixed")

    active = work.save(_active(_units(mixed, block), shorts), "active")
    if not active.isEmpty():
        wanted = work.save(active.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti"), "wanted-rest")
        sets = sets.unionByName(work.save(_sets(texts, wanted), "sets-rest"))
        left = mixed.select("node", "rep", "label").join(active, ["node", "rep"], "left_semi")
        edges = edges.unionByName(work.save(_joining(_units(left, set_block), shorts, sets, threshold), "edges-rest"))
    parts = connected_components(edges, work)
    for done in ("sets-hub", "sets-rest", "shorts", "members", "mixed", "active"):
        work.drop(done)
    recall = None
    if audit:
        one, two = (true.join(parts, F.col(end) == parts["node"], "left").select("a", "b", F.coalesce("component", F.col(end)).alias(f"of_{end}")) for end in ("a", "b"))
        total, found = one.join(two, ["a", "b"]).agg(F.count("*"), F.sum((F.col("of_a") == F.col("of_b")).cast("int"))).first()
        recall = found / total if total else 1.0
    own = sketches.select("doc", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    out = own.join(parts, own["rep"] == parts["node"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    out = out.select("doc", "n_shingles", component.alias("component_id"))
    out = out.withColumn("kept", F.col("doc").isNull() | (F.col("doc") == F.col("component_id"))).withColumn("audit_recall", F.lit(recall).cast("double"))
    return out.withColumnRenamed("doc", key)

"""Best-fit packing with swap-based local search (operator 8).

Documents become token ids plus an end token.  One longer than a sequence is cut into
full pieces; the piece that is left over, if any, comes first.  Full pieces are
sequences by themselves.  The others are dealt into groups of a bounded size by a hash of
their row number, and each group is packed alone: best fit in decreasing order, then
local search among the bins that are not full.  The search moves a piece, exchanges
one for one, two for one or one for two whenever that raises the sum of squared fills,
which drains the emptiest bins until they vanish.  A group wastes about one bin, so of
``group_size`` pieces the loss is a fraction of a percent at any scale.
"""

from __future__ import annotations

import math
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.bpe import encoded
from quadrille.llm.common import Workspace

#: The end-of-document id, the sequence length, and the pieces that one task packs together.
END, LENGTH, GROUP = 2, 1024, 16_384


def cut_pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in decreasing order: bins of item numbers.

    A bit set of the free sizes present finds the tightest bin that fits in one step.
    """
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    present = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = present >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            b = by_free[free].pop()
            if not by_free[free]:
                present ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > size:
            left = free - size
            by_free.setdefault(left, []).append(b)
            present |= 1 << left
    return bins


def _step(a: list[int], b: list[int], sizes: np.ndarray, free_b: int, lead: int) -> tuple[list[int], list[int]] | None:
    """Items to move from a to b and back that add the most to b, at most free_b, and more than lead."""
    best, found = lead, None
    sa, sb = sizes[a], sizes[b]
    single = np.concatenate([sa, np.zeros(0, dtype=sa.dtype)])
    options = [(single, [(i,) for i in a])]
    if len(a) > 1:
        p, q = np.triu_indices(len(a), 1)
        options.append((sa[p] + sa[q], [(a[x], a[y]) for x, y in zip(p.tolist(), q.tolist())]))
    back = [(np.zeros(1, dtype=sa.dtype), [()]), (sb, [(j,) for j in b])]
    if len(b) > 1:
        p, q = np.triu_indices(len(b), 1)
        back.append((sb[p] + sb[q], [(b[x], b[y]) for x, y in zip(p.tolist(), q.tolist())]))
    for give, given in options:
        for take, taken in back:
            if len(given[0]) == 2 and len(taken[0]) == 2:
                continue
            gain = give[:, None] - take[None, :]
            gain = np.where(gain <= free_b, gain, -1)
            at = int(np.argmax(gain))
            if gain.flat[at] > best:
                best = int(gain.flat[at])
                i, j = divmod(at, gain.shape[1])
                found = (list(given[i]), list(taken[j]))
    return found


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, most_partners: int = 64, most_rounds: int = 50, most_pieces: int = 96) -> list[list[int]]:
    """Raise the sum of squared fills among bins that are not full; empty bins go.

    A round takes the bins from the emptiest up and looks for partners among the fullest
    that still have room.  Each step raises the sum of squares, a whole number, so it
    ends.  Bins of more than ``most_pieces`` items only give and take single items of
    their largest ``most_pieces``.
    """
    fill = [int(sizes[b].sum()) for b in bins]
    for _ in range(most_rounds):
        moved = False
        under = sorted((i for i in range(len(bins)) if 0 < fill[i] < capacity), key=fill.__getitem__)
        for a in under:
            partners = sorted((i for i in under if i != a and fill[a] <= fill[i] < capacity), key=lambda i: -fill[i])[:most_partners]
            for b in partners:
                if not bins[a] or fill[b] >= capacity:
                    continue
                view = [sorted(bins[x], key=lambda i: -sizes[i])[:most_pieces] for x in (a, b)]
                step = _step(*view, sizes, capacity - fill[b], max(0, fill[a] - fill[b]))
                if step:
                    give, take = step
                    bins[a] = [i for i in bins[a] if i not in give] + take
                    bins[b] = [i for i in bins[b] if i not in take] + give
                    fill[a], fill[b] = int(sizes[bins[a]].sum()), int(sizes[bins[b]].sum())
                    moved = True
        if not moved:
            break
    return [b for b in bins if b]


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


PIECES = "array<struct<piece int, start long, length long, ids_crc32 long>>"


def pieces(docs: DataFrame, vocabulary: str, key: str, text: str, length: int, end: int) -> DataFrame:
    """One row per piece: _key, piece, start, length, ids_crc32.  A null text is empty."""

    def cut(value: str | None) -> list[tuple[int, int, int, int]]:
        ids = encoded(vocabulary, value or "")
        ids.append(end)
        data = memoryview(array("I", ids)).cast("B") if sys.byteorder == "little" else memoryview(np.array(ids, dtype="<u4").tobytes())
        return [(number, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])) for number, (start, n) in enumerate(cut_pieces(len(ids), length))]

    # keys stay out of Python, so a null key can't change the kind of the others
    @F.pandas_udf(PIECES)
    def cuts(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(value) for value in texts])

    return docs.select(F.col(key).alias("_key"), F.explode(cuts(F.col(text))).alias("_p")).select("_key", "_p.*")


def pack_documents(docs: DataFrame, work: Workspace, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, group_size: int = GROUP) -> DataFrame:
    """Every piece with its place: key, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is a file of byte-level ranks; the string of its end-of-text token is
    that token, as the tokenizers library has it by default.  Null keys and repeated rows are packed
    as documents of their own; an empty table gives no sequences; other columns are not
    read.  The table of pieces is written once, so row numbers stay the same when tasks
    run again.
    """
    table = work.save(pieces(docs, vocabulary, key, text, length, end).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < length
    n_part = table.where(part).count()
    groups = max(1, math.ceil(n_part / group_size))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy(dtype=np.int64)
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        for number, items in enumerate(pack(sizes, length)):
            inside = sizes[items]
            sequence[items] = number
            offset[items] = np.cumsum(inside) - inside
        return frame.assign(sequence_id=(frame["_group"].to_numpy(dtype=np.int64) << 32) + sequence, offset=offset)

    kind = table.schema["_key"].dataType
    dealt = table.where(part).withColumn("_key", F.col("_key").cast("string")).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # a partition for each group, whatever its bytes: the search is what takes time
    packed = dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(run, schema).drop("_group").withColumn("_key", F.col("_key").cast(kind))
    # full pieces: numbers below zero, so they never meet those of the groups
    full = table.where(~part).withColumn("sequence_id", -F.col("_row") - 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full).drop("_row").withColumnRenamed("_key", key)

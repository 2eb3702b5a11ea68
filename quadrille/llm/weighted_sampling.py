"""Document fingerprints by consistent weighted sampling, with DataFrame operations only (operator 6).

For each of K samples a term of weight w draws r and c from Gamma(2, 1) and b from
U(0, 1), all from a hash of the term and the sample's number (Ioffe, "Improved
consistent sampling, weighted minhash and L1 sketching"):

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r

The sample is the (term, t) of the smallest a.  Two documents agree in a sample with a
probability that is the generalised Jaccard similarity of their weights, the sum of
minima over the sum of maxima.  Terms are words, weights their counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Rows of one bucket, and most buckets, in the order of keys.
BUCKET_ROWS, LEVEL = 1024, 64
_LOWEST, _SCALE = 40.0, float(1 << 41)  # ln a + _LOWEST is positive and below 64


def _unit(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from some of the bits."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0**-width)


def packed_sample(term: Column, log_weight: Column, k: Column) -> Column:
    """A long whose order is that of a and whose low 16 bits name (term, t)."""
    one = F.xxhash64(term, k)
    two = F.xxhash64(one)
    r = -F.ln(_unit(one, 0, 20) * _unit(one, 20, 20))  # the sum of two exponential draws
    c = F.ln(-F.ln(_unit(two, 0, 24) * _unit(two, 24, 24)))
    b = _unit(one, 40, 24)
    t = F.floor(log_weight / r + b)
    order = ((c - r * (t - b) - r + F.lit(_LOWEST)) * F.lit(_SCALE)).cast("long")
    name = F.shiftrightunsigned(two, 48).bitwiseXOR((t * 40503).bitwiseAND(F.lit(0xFFFF)))
    return F.shiftleft(order, 16).bitwiseOR(name)


def _sketches(rows: DataFrame, keys: list[str], sides: list[str], samples: int) -> DataFrame:
    """By ``keys`` an array of packed names for each text column in ``sides``; null where it has no words."""
    texts = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(sides)])).alias("s"))
    terms = texts.select(*keys, "s.side", F.explode(F.split("s.text", r"\s+")).alias("word")).where("word != ''")
    terms = terms.select(*keys, "side", F.xxhash64("word").alias("term"))
    weights = terms.groupBy(*keys, "side", "term").agg(F.ln(F.count("*")).alias("w"))
    # a lane of four samples a row: one aggregation of all would be too large a method to be compiled
    lanes = range(samples // 4)
    rows = weights.select(*keys, "side", "term", "w", F.explode(F.array(*map(F.lit, lanes))).alias("lane"))
    least = [F.min(packed_sample(F.col("term"), F.col("w"), F.col("lane") * 4 + k)).alias(f"m_{k}") for k in range(4)]
    found = rows.groupBy(*keys, "side", "lane").agg(*least)
    low = [F.col(f"m_{k}").bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    found = found.select(*keys, "side", "lane", F.shiftleft(low[0], 48).bitwiseOR(F.shiftleft(low[1], 32)).bitwiseOR(F.shiftleft(low[2], 16)).bitwiseOR(low[3]).alias("p"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when((F.col("side") == i) & (F.col("lane") == j), F.col("p"))).alias(f"p{i}_{j}") for i in range(len(sides)) for j in lanes])
    return wide.select(*keys, *[F.when(F.col(f"p{i}_0").isNotNull(), F.array(*[F.col(f"p{i}_{j}") for j in lanes])).alias(f"sketch{i}") for i in range(len(sides))])


def as_text(sketch: Column, samples: int = SAMPLES) -> Column:
    """The fingerprint as lowercase hex, four digits a sample; ``empty`` for a text without words."""
    digits = F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit("empty"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The part of the samples that agree: 1 for two texts without words, 0 for one."""
    lanes = [(0xFFFF << s) - (1 << 64) if s == 48 else 0xFFFF << s for s in (0, 16, 32, 48)]

    def agreeing(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        return sum((F.when(differ.bitwiseAND(F.lit(m)) == 0, 1).otherwise(0) for m in lanes), F.lit(0))

    total = F.aggregate(F.zip_with(a, b, agreeing), F.lit(0), lambda x, y: x + y)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(total / float(samples))


def _bucket(key: Column, bounds: list) -> Column:
    """How many of the bounds (at most LEVEL x LEVEL, in order) are not above the key; in two steps."""
    if not bounds:
        return F.lit(0)
    rows = [bounds[i : i + LEVEL] for i in range(0, len(bounds), LEVEL)]
    tops = F.array(*[F.lit(r[0]) for r in rows])
    row = F.size(F.filter(tops, lambda x: x <= key))
    inner = F.get(F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows]), row - 1)
    return F.when(key.isNull() | (row == 0), 0).otherwise((row - 1) * LEVEL + F.size(F.filter(inner, lambda x: x <= key)))


def with_successors(docs: DataFrame, key: str, text: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, place, key, text, following, guest) in the order of keys.

    ``following`` is the text of the next row, after the last that of the first.  Keys are
    dealt into buckets of neighbours by quantiles; the first key of each bucket is also a
    guest in the bucket before it, so that every row finds its successor in its own
    bucket.  The driver sees at most LEVEL x LEVEL quantiles and smallest keys.  Null
    keys come first; rows of one key are ordered by a hash of their text.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(LEVEL * LEVEL, math.ceil(n / bucket_rows)))
    cuts = []
    if parts > 1:
        cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * LEVEL * LEVEL)).first()[0] or []
    bounds = sorted(set(cuts))
    bucket = _bucket(F.col("key"), bounds).cast("int")
    smallest = {r["b"]: r["k"] for r in rows.select(bucket.alias("b"), "key").groupBy("b").agg(F.min("key").alias("k"), F.max(F.col("key").isNull()).alias("none")).select("b", F.when(~F.col("none"), F.col("k")).alias("k")).collect()}
    order = sorted(smallest)
    if not order:
        order, smallest = [0], {0: None}
    before = dict(zip(order[1:], order))
    visits = F.lit(None).cast("int")
    if before:
        at = F.array(*[F.lit(before.get(b)).cast("int") for b in range(max(order) + 1)])
        first = F.array(*[F.lit(smallest[b] if b in before else None).cast("long") for b in range(max(order) + 1)])
        visits = F.when(F.get(first, F.col("bucket")) == F.col("key"), F.get(at, F.col("bucket")))
    begins = F.col("key").eqNullSafe(F.lit(smallest[order[0]]))
    homes = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(visits.alias("bucket"), F.lit(1).alias("guest")), F.struct(F.when(begins, order[-1]).alias("bucket"), F.lit(2).alias("guest")))
    dealt = rows.withColumn("bucket", bucket).withColumn("home", F.explode(homes)).where("home.bucket is not null")
    dealt = dealt.select("home.bucket", "home.guest", "key", "text")
    here = Window.partitionBy("bucket").orderBy(F.when(F.col("guest") == 2, 1).otherwise(0), F.col("key").asc_nulls_first(), F.xxhash64("text"), "guest")
    return dealt.withColumn("place", F.row_number().over(here)).withColumn("following", F.lead("text").over(here))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many
    (or all) of the next row's text.  A null text is empty; texts without words have the
    fingerprint ``empty`` and likeness 1 with each other.  Keys are numbers; null keys come
    first and repeated keys are rows of their own.  An empty table gives an empty table;
    other columns are not read.
    """
    n = F.length("text").cast("long")
    rows = with_successors(docs, key, text, bucket_rows)
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 2))"), F.coalesce(F.expr("substring(following, 1, int(length(text) div 2))"), F.lit(""))))
    info = rows.select("bucket", "place", "guest", "key", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    found = _sketches(rows, ["bucket", "place"], ["text", "edited"], samples)
    joined = info.join(found, ["bucket", "place"], "left")
    joined = joined.withColumn("next_sketch", F.lead("sketch0").over(Window.partitionBy("bucket").orderBy("place"))).where("guest = 0")
    return joined.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", as_text(F.col("sketch0")).alias("fingerprint"), as_text(F.col("sketch1")).alias("edited_fingerprint"),
        likeness(F.col("sketch0"), F.col("sketch1"), samples).alias("near_edited"), likeness(F.col("sketch0"), F.col("next_sketch"), samples).alias("near_next"),
    )

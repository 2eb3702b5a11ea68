"""Fuzzy line deduplication with DataFrame operations only (operator 3).

Lines are normalised (lower case, runs of anything but letters and digits to one space).
Two link if their edit similarity is at least SIMILARITY: nothing else decides.

Pairs to verify come from a SimHash in blocks.  A SimHash over all of a line's features
cannot propose them: at edit similarity 0.9 it differs in 9 of 64 bits, and blocks short
enough to agree then are shared by most of a large corpus.  Here every block has features
of its own: a feature (a word, in short lines a run of three characters) belongs to the
block that its hash names, and a block's bits are the majority votes of its features
alone.  A line has about one block for every few features (a power of two, so that lines
of nearly the same size have the same blocks), so an edit changes the one or two blocks
of the features that it touches, and by the pigeonhole principle the others agree whole.
The first BLOCKS blocks are joined on; blocks of too few features are left out.

Of each connected group one occurrence stays, the one of the smallest (document, position).

Equal normalised lines are one node from the start, so counts of copies do not matter
afterwards.  In each bucket every line first meets one hub, in large ones then some more;
only lines that this leaves in different components meet each other: all of them, in
buckets of any size, each pair in the first bucket that it shares.  Their lengths and the
counts of their letters, from which an edit moves at most two, tell most of those apart
before any text is read, and never two lines that link.  So a large group of near copies
costs a few pairs for each of its lines, and lines that share a passage alone mostly a
comparison of five longs for each pair.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Workspace
from quadrille.llm.components import connected_components

SIMILARITY, BLOCKS, HUBS, LARGE = 0.9, 8, 8, 64
#: (kind, least and most characters of the line, features a block).  A block counts if its words have LETTERS letters, or if it has RUNS runs.
#: The lengths overlap, and so do the sizes at which the number of blocks doubles (EDGE, a part of a doubling).
KINDS, LETTERS, RUNS = [("words", 90, 1 << 31, 4), ("runs", 0, 112, 2)], 16, 2
RUN, EDGE = 5, 0.2
#: Votes for a bit are counted in ten lanes of six bits of a long: the lanes' lowest and highest bits, and half of what a lane holds.
_ONES, _TOPS, _HALF, _SUMS = 0o01010101010101010101, 0o40404040404040404040, 31, 3
#: Longer lines are first cut at words that both have equally often, if there are enough of them; up to there that takes longer than the distance itself.
_PLAIN, _ANCHORS, _CUT = 2048, 4, "\u0001"
_LENGTH = 15
#: Letters whose counts tell lines apart, by columns, and the bits for each: more for frequent ones.  The last column also has 32 bits for all other characters.
_LETTERS = [(" eta", 16), ("oins", 16), ("hrdl", 16), ("cumwfgyp", 8), ("bvkx", 8)]
_COUNTS = [f"letters_{i}" for i in range(len(_LETTERS))]
#: In larger buckets the lines that meet all others are dealt over several tasks, about so many for each.
_DEALT = 4096
#: About so many lines are taken apart in one task.
_TAKEN = 1 << 15


def normalised_lines(text: Column) -> Column:
    """The normalised lines of a text; what is replaced never holds a line end, so the whole text is replaced at once."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), "\n", -1)


def _row_hash(key: str, text: str) -> Column:
    """Tells rows of one key with different texts apart."""
    return F.xxhash64(F.col(key), F.col(text))


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line that has a letter or digit: doc, row, pos, two hashes of the normalised line, and that line."""
    lines = docs.select(F.col(key).alias("doc"), _row_hash(key, text).alias("row"), F.posexplode(normalised_lines(F.col(text))).alias("pos", "line"))
    lines = lines.select("doc", "row", "pos", F.trim("line").alias("norm")).where("norm != ''")
    return lines.select("doc", "row", "pos", F.xxhash64("norm").alias("line_a"), F.xxhash64(F.lit(7), "norm").alias("line_b"), "norm")


def _features(kind: str, norm: Column) -> Column:
    """Hashes of the distinct features."""
    if kind == "words":
        # the low bits hold the word's length, by which blocks of a few short, common words are left out
        found = F.transform(F.split(norm, " "), lambda w: F.xxhash64(w).bitwiseAND(F.lit(~_LENGTH)).bitwiseOR(F.least(F.length(w), F.lit(_LENGTH)).cast("long")))
    else:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(norm) - (RUN - 1)))
        found = F.transform(starts, lambda i: F.xxhash64(F.substring(norm, i, F.lit(RUN))))
    return F.array_distinct(found)


def _levels(n: Column, features: int) -> Column:
    """Binary logarithms of the numbers of blocks for n features: one, or two near a doubling."""
    exact = F.log2(F.greatest(n / F.lit(float(features)), F.lit(1.0)))
    level = F.floor(exact).cast("int")
    none = F.lit(None).cast("int")
    around = F.array(F.when((exact - level < EDGE) & (level > 0), level - 1).otherwise(none), level, F.when(level + 1 - exact < EDGE, level + 1).otherwise(none))
    return F.filter(around, lambda x: x.isNotNull())


def _votes(counts: Column, n: Column) -> Column:
    """Ten bits of a block's SimHash, each set if more than half of its n features have it.  Of more than 62 features lanes run over, for equal blocks alike."""
    return (counts + (F.lit(_HALF) - F.floor(F.least(n, F.lit(2 * _HALF)) / 2)) * F.lit(_ONES)).bitwiseAND(F.lit(_TOPS))


def buckets(lines: DataFrame) -> DataFrame:
    """(bucket, line, size) of every block of every line (id, norm) that has enough features; size is the line's length.

    A line of one block always has it.  Lines are dealt by their id before they are taken
    apart, so votes are added where the line is and only its text is shuffled.
    """
    lines = lines.repartition(lines.count() // _TAKEN + 1, "id")
    length = F.length("norm")
    kinds = [F.when(length.between(low, high), F.struct(F.lit(number).alias("kind"), _features(kind, F.col("norm")).alias("features"))) for number, (kind, low, high, _) in enumerate(KINDS)]
    found = lines.select(F.col("id").alias("line"), length.alias("size"), F.explode(F.array(*kinds)).alias("k")).where("k is not null").select("line", "size", "k.*")
    by_kind = lambda value: reduce(lambda rest, i: F.when(F.col("kind") == i, value(i)).otherwise(rest), range(1, len(KINDS)), value(0))
    found = found.select("line", "size", "kind", F.explode(by_kind(lambda i: _levels(F.size("features"), KINDS[i][3]))).alias("level"), "features")
    found = found.select("line", "size", "kind", "level", F.explode("features").alias("h"))
    block = F.call_function("shiftrightunsigned", F.shiftrightunsigned("h", 1), F.lit(63) - F.col("level"))
    found = found.where(block < BLOCKS).select("line", "size", (block * 256 + F.col("level") * 2 + F.col("kind")).cast("int").alias("slot"), "h")
    letters = F.sum(F.col("h").bitwiseAND(F.lit(_LENGTH))).alias("letters")
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_ONES))).alias(f"s{i}") for i in range(_SUMS)]
    blocks = found.groupBy("line", "size", "slot").agg(F.count("*").cast("int").alias("n"), letters, *sums)
    enough = F.when(F.col("slot") % 2 == 0, F.col("letters") >= LETTERS).otherwise(F.col("n") >= RUNS)
    counted = blocks.where(enough | (F.col("slot") % 256 < 2))
    return counted.select(F.xxhash64("slot", *[_votes(F.col(f"s{i}"), F.col("n")) for i in range(_SUMS)]).alias("bucket"), "line", "size")


def _most(a: Column | str, b: Column | str, similarity: float) -> Column:
    """The most edits between two linked lines of these lengths."""
    return F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9).cast("int")


def _in_reach(a: str, b: str, similarity: float) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= _most(a, b, similarity)


def _counts(norm: Column) -> list[Column]:
    """The counts of _LETTERS: codes of neighbouring counts, modulo twice the bits, differ in one bit, so codes differ in no more bits than counts in letters."""

    def code(n: Column, bits: int) -> Column:
        ones = F.lit((1 << bits) - 1).cast("long")
        return F.shiftright(F.call_function("shiftleft", ones, n.bitwiseAND(F.lit(2 * bits - 1))), bits).bitwiseAND(ones)

    n = lambda letter: F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(letter), F.lit("")))
    lanes = [[F.shiftleft(code(n(letter), bits), bits * i) for i, letter in enumerate(letters)] for letters, bits in _LETTERS]
    others = F.length(F.translate(norm, "".join(letters for letters, _ in _LETTERS), ""))
    lanes[-1].append(F.shiftleft(code(others, 32), 32))
    return [reduce(lambda x, y: x.bitwiseOR(y), lane).alias(name) for lane, name in zip(lanes, _COUNTS, strict=True)]


def _alike(size_a: str, size_b: str, counts_a: list[str], counts_b: list[str], similarity: float) -> Column:
    """False for lines that their letters keep from being linked: an edit adds a letter, drops one or does both, and lengths say how many only do one."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(counts_a, counts_b, strict=True)])
    return apart <= 2 * _most(size_a, size_b, similarity) - F.abs(F.col(size_a) - F.col(size_b))


def _ends(words: Column) -> Column:
    """The distinct words in order, each with the place where it ends among all words in order."""
    ordered = F.sort_array(words)
    last = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(words)), lambda x, y: F.when(~x.eqNullSafe(y), x))
    return F.filter(F.transform(last, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda e: e["word"].isNotNull())


def _tallied(ends: Column) -> Column:
    """The distinct words, each with the number of times that it occurs."""
    before = F.concat(F.array(F.lit(-1)), F.transform(ends, lambda e: e["at"]))
    return F.array_compact(F.zip_with(ends, before, lambda e, at: F.when(e.isNotNull(), F.concat(e["word"], F.lit(_CUT), (e["at"] - at).cast("string")))))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have an edit distance of at most ``most``.

    Letters that keep two lines apart decide first.  The distance itself costs the square
    of the length; very long lines that link are mostly settled by less: words that both have equally often, all in the same order, cut both into pieces,
    and the pieces' distances add up to no less than the lines', so a sum within ``most``
    links them.  Where it is above, the distance itself decides.
    """
    side = lambda x: texts.select(F.col("line").alias(x), F.col("norm").alias(f"text_{x}"), F.length("norm").alias(f"size_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in _COUNTS])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("size_a", "size_b", [f"{c}_a" for c in _COUNTS], [f"{c}_b" for c in _COUNTS], similarity))
    joined = joined.select("a", "b", "text_a", "text_b", _most("size_a", "size_b", similarity).alias("most"))
    longer = F.greatest(F.length("text_a"), F.length("text_b")) > _PLAIN
    none = F.array().cast("array<string>")
    cut = joined.select("*", F.when(longer, F.split("text_a", " ")).otherwise(none).alias("words_a"), F.when(longer, F.split("text_b", " ")).otherwise(none).alias("words_b"))
    # a column each, because a lambda would evaluate anew what it reads
    cut = cut.select("*", _ends(F.col("words_a")).alias("ends_a"), _ends(F.col("words_b")).alias("ends_b"))
    equal = F.array_intersect(_tallied(F.col("ends_a")), _tallied(F.col("ends_b")))
    cut = cut.select("*", F.transform(equal, lambda x: F.substring_index(x, _CUT, 1)).alias("anchors"))
    anchored = lambda words: F.filter(words, lambda w: F.array_contains("anchors", w))
    marked = lambda words: F.split(F.array_join(F.transform(words, lambda w: F.when(F.array_contains("anchors", w), F.lit(_CUT)).otherwise(w)), " "), _CUT)
    edits = lambda x, y: F.call_function("levenshtein", x, y, F.col("most"))  # noqa: E731  -1 above most
    far = F.lit(1 << 20)
    in_order = (F.size("anchors") >= _ANCHORS) & (anchored("words_a") == anchored("words_b"))
    pieces = F.aggregate(F.zip_with(marked("words_a"), marked("words_b"), lambda x, y: F.when(x == y, 0).otherwise(F.pmod(edits(x, y), far))), F.lit(0), lambda acc, x: F.least(acc + x, far))
    linked = F.when(longer & in_order & (pieces <= F.col("most")), True).otherwise(edits(F.col("text_a"), F.col("text_b")) >= 0)
    # one evaluation a pair: a filter would be pushed below the columns it reads
    return cut.select(F.explode(F.when(linked, F.array(F.struct("a", "b")))).alias("p")).select("p.*")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that meet more than one component, with the component as label."""
    labels = parts.select(F.col("node").alias("line"), F.col("component").alias("label"))
    named = members.join(labels, "line", "left").withColumn("label", F.coalesce("label", "line"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    return named.join(mixed, "bucket", "left_semi")


def line_links(lines: DataFrame, work: Workspace, similarity: float) -> DataFrame:
    """(node, component) of lines (id, norm) that link with another but each component's smallest."""
    keys = buckets(lines).repartition("bucket")
    # the counts and the join read one exchange
    shared = keys.groupBy("bucket").agg(F.count("*").alias("lines"), F.min(F.struct("line", "size")).alias("h")).where("lines > 1").select("bucket", "lines", F.col("h.line").alias("hub"), F.col("h.size").alias("hub_size"))
    members = work.save(keys.join(shared, "bucket"), "members")
    first = work.save(members.where((F.col("line") != F.col("hub")) & _in_reach("size", "hub_size", similarity)).select(*_ordered("line", "hub")).distinct(), "pairs-hub")
    # besides those of pairs, lines of larger buckets may meet later
    wanted = first.select(F.explode(F.array("a", "b")).alias("line")).union(members.where("lines > 2").select("line")).distinct()
    texts = lines.select(F.col("id").alias("line"), "norm").join(wanted, "line", "left_semi")
    texts = work.save(texts.select("line", "norm", *_counts(F.col("norm"))), "texts")
    edges = work.save(_verified(first, texts, similarity), "edges-hub")
    several = members.where("lines > 2").select("bucket", "lines", "line", "size")
    parts = connected_components(edges, work, "parts-hub")
    mixed = work.save(_labelled(several, parts), "mixed")
    large = mixed.where(F.col("lines") > LARGE)
    if not large.isEmpty():  # buckets that one hub did not settle get about HUBS more, drawn by a hash
        drawn = large.where(F.pmod(F.xxhash64(F.lit(1), F.col("line")), F.col("lines")) < HUBS)
        drawn = drawn.select("bucket", F.col("line").alias("hub"), F.col("size").alias("hub_size"), F.col("label").alias("hub_label"))
        pairs = large.join(drawn, "bucket").where((F.col("label") != F.col("hub_label")) & _in_reach("size", "hub_size", similarity)).select(*_ordered("line", "hub")).distinct()
        edges = edges.unionByName(work.save(_verified(pairs, texts, similarity), "edges-drawn"))
        parts = connected_components(edges, work, "parts-drawn")
        mixed = work.save(_labelled(several, parts), "mixed-drawn")
    rest = _rest_pairs(mixed, texts, similarity)
    more = work.save(_verified(rest, texts, similarity), "edges-rest")
    return parts if more.isEmpty() else connected_components(edges.unionByName(more), work)


def _rest_pairs(mixed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Every pair of different components that shares a bucket of any size, once, but those that lengths or letters keep from being linked."""
    every = mixed.groupBy("line").agg(F.collect_set("bucket").alias("every"))
    counted = mixed.join(every, "line").join(texts.select("line", *_COUNTS), "line")
    # lengths of linked lines are in the same class or in neighbouring ones
    sized = counted.withColumn("class", F.floor(F.log("size") / -math.log(similarity)))
    parts = F.ceil(F.col("lines") / _DEALT).cast("int")
    line = F.struct("line", "size", "label", "class", "every", *_COUNTS)
    one = sized.select("bucket", F.col("class").alias("at"), F.pmod(F.xxhash64(F.lit(2), F.col("line")), parts).cast("int").alias("part"), line.alias("x"))
    two = sized.select("bucket", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("at"), parts.alias("parts"), line.alias("y"))
    two = two.select("bucket", "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y")
    once = (F.col("x.class") != F.col("y.class")) | (F.col("x.line") < F.col("y.line"))
    apart = (F.col("x.label") != F.col("y.label")) & _in_reach("x.size", "y.size", similarity)
    alike = _alike("x.size", "y.size", [f"x.{c}" for c in _COUNTS], [f"y.{c}" for c in _COUNTS], similarity)
    met = reduce(lambda x, y: x & y, [one[c] == two[c] for c in ("bucket", "at", "part")])
    first = F.array_min(F.array_intersect("x.every", "y.every")) == one["bucket"]
    return one.join(two, met & apart & once & alike & first).select(*_ordered("x.line", "y.line"))


def dedup_lines(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines removed that repeat another, and columns n_lines, n_removed.

    Lines without letters and digits always stay and count in n_lines.  A null text stays
    null with 0 lines; a text may become empty but its row stays.  Rows that are equal in
    key and text are one document: both keep or lose the same lines.  A null key is
    a document before all others.  An empty table gives an empty table.  Columns of
    ``docs`` named n_lines or n_removed are replaced; all others are kept as they are.
    Lines of any length are compared whole.
    """
    seen = work.save(occurrences(docs, key, text), "occurrences")
    lines = seen.groupBy("line_a", "line_b").agg(F.first("norm").alias("norm"), F.min(F.struct("doc", "row", "pos")).alias("at"), F.count("*").alias("n"))
    # written once, so a line keeps its number
    lines = work.save(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    seen = work.save(seen.drop("norm"), "seen")
    work.drop("occurrences")
    parts = work.save(line_links(lines, work, similarity), "parts")
    # a component's smallest line has no row in parts
    linked = parts.select(F.col("node").alias("id"), "component").unionByName(parts.select(F.col("component").alias("id"), "component").distinct())
    grouped = work.save(lines.select("id", "line_a", "line_b", "at").join(linked, "id"), "grouped")
    first = grouped.groupBy("component").agg(F.min("at").alias("stays"))
    alone = lines.where("n > 1").select("id", "line_a", "line_b", F.col("at").alias("stays")).join(linked, "id", "left_anti")
    kept = grouped.join(first, "component").select("line_a", "line_b", "stays").unionByName(alone.select("line_a", "line_b", "stays"))
    gone = seen.join(kept, ["line_a", "line_b"]).where(~F.struct("doc", "row", "pos").eqNullSafe(F.col("stays")))
    words = gone.groupBy("doc", "row", F.floor(F.col("pos") / 64).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    marks = words.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("_bits"), F.sum(F.bit_count("bits")).alias("n_removed"))
    marks = work.save(marks.withColumnRenamed("doc", "_doc").withColumnRenamed("row", "_row"), "marks")
    for done in ("seen", "lines", "members", "texts", "grouped"):
        work.drop(done)

    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], _row_hash(key, text).alias("_hash"))
    joined = rows.join(marks, rows[key].eqNullSafe(marks["_doc"]) & (rows["_hash"] == marks["_row"]), "left")
    split = F.split(F.col(text), "\n", -1)

    def stays_at(line: Column, i: Column) -> Column:
        marked = F.coalesce(F.try_element_at("_bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return marked.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0

    stays = F.filter(split, stays_at)
    cleaned = F.when(F.col("_bits").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))
    out = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in columns]
    return joined.select(*out, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))

"""The corpus operators against brute force, with nulls, empty tables, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import attribution, chosen_path, flat_graph, importance, line_dedup, packing, spm_bpe, toxicity, warc, weighted_sampling
from quadrille.llm.common import Workspace
from quadrille.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "  two  spaces \n\n x\t", "naïve 日本語 😀😀 l'été", "it's <|endoftext|> 12345 ...", " x y z", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = [" ".join(rng.choices(words, k=rng.randint(5, 160))) for _ in range(60)]
    for i in range(0, 30, 2):  # near copies, and a chain of them
        w = out[i].split(" ")
        for j in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + out[:5] + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3)


def work(spark):
    return Workspace(spark, "test")


def tk():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_ranks_encoding(docs, texts):
    enc = tk()
    got = {r["doc_id"]: r for r in spm_bpe.encode_documents(docs, RANKS).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want and got[i]["round_trip"]
    assert spm_bpe.encode_documents(docs.limit(0), RANKS).count() == 0


def test_attribution_rules(docs, texts, spark):
    enc = attribution.span_encoder(RANKS)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    total = Counter()
    for r in attribution.token_counts(docs, RANKS).collect():
        total[r["doc_id"]] += r["n_tokens"]
    for i, t in enumerate(texts):
        spans = list(zip(*(a.tolist() for a in enc.spans(t or ""))))
        assert spans == [tuple(o) for o in lib.encode(t or "", add_special_tokens=False).offsets]
        assert total[i] == len(spans)
    starts, ends = np.array([0, 3, 6]), np.array([3, 6, 9])
    low, high = np.array([0, 4, 4]), np.array([4, 8, 8])
    assert attribution.allocate(starts, ends, low, high, "majority")[0].tolist() == [1, 2, 0]
    assert attribution.allocate(starts, ends, low, high, "start")[0].tolist() == [2, 1, 0]
    assert attribution.allocate(starts, ends, low[:2], high[:2], "share")[0].tolist() == pytest.approx([1 + 1 / 3, 2 / 3 + 1])
    spanned = spark.createDataFrame([(1, "hello world", [(0, 3), (None, 2), (9, 4)]), (2, None, None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = {(r["doc_id"], r["section"]): r["n_tokens"] for r in attribution.token_counts(spanned, RANKS, sections="parts").collect()}
    assert rows == {(1, 0): 1, (1, 1): 0, (1, 2): 0, (1, -1): 1}


def shingles(t):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label
    return label


def test_near_duplicates_are_all_links(spark, docs, texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    for leaf, block in ((64, 512), (2, 4)):  # small blocks: many units a leaf
        got = {r["doc_id"]: r for r in chosen_path.near_duplicates(docs, work(spark), leaf=leaf, block=block, set_block=max(2, block // 2), trees=4).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert all(got[i]["kept"] == (want[i] == i) for i in got)
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "A\tB"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in chosen_path.near_duplicates(odd, work(spark)).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert chosen_path.near_duplicates(docs.limit(0), work(spark)).count() == 0


def test_short_signatures_count_agreeing_coordinates():
    rng = np.random.default_rng(7)
    low = rng.integers(256, size=(2, 40, chosen_path.COORDINATES), dtype=np.uint8)
    low[1, :20] = np.where(rng.random((20, chosen_path.COORDINATES)) < 0.8, low[0, :20], low[1, :20])
    one, two = (chosen_path._shorts([chosen_path.short(np.stack([x, x])).tobytes() for x in side]) for side in low)
    assert chosen_path.agreeing(one, two).tolist() == ((low[0] & 15) == (low[1] & 15)).sum(axis=1).tolist()


def test_near_duplicates_with_the_production_trees(spark, docs, texts):
    n = chosen_path.COORDINATES
    p = 0.75 + 0.25 / 16  # unlike coordinates agree in one case of 16
    lost = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n) if i < chosen_path.LEAST_AGREEING)
    assert lost < 1e-5  # of the pairs at the threshold, by the signatures
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(docs, work(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), links)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(150, 200)] + [(None, 3)]
    want = components(200, [p for p in pairs if None not in p])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), work(spark)).collect()}
    assert [got.get(i, i) for i in range(200)] == want


def norm(line):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_groups(texts):
    """Lines (row, position) that brute force removes: all but the first of each group linked by edit similarity 0.9."""
    lines = [(i, p, norm(x)) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if norm(x)]
    links = []
    for a, (_, _, x) in enumerate(lines):
        for b, (_, _, y) in enumerate(lines[:a]):
            most = math.floor(0.1 * max(len(x), len(y)) + 1e-9)
            if x == y or abs(len(x) - len(y)) <= most and lev(x, y) <= most:
                links.append((a, b))
    label = components(len(lines), links)
    return {lines[a][:2] for a in range(len(lines)) if label[a] != a}


def test_line_dedup(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    near = [b + " " + b.split(" ")[0][:-1] + "q" for b in base[:3]]
    long = " ".join(rng.choices(words, k=700))  # compared by pieces
    texts = ["\n".join([base[0], "", base[1], "..."]), "\n".join([base[0].upper() + "!", base[2]]), "\n".join([near[0], base[3], "ab"]), near[1] + "\n" + near[2] + "\nAB.", base[4], None, "", base[4], long, long.replace(words[3], "other"), " \t\n\n"]
    df = spark.createDataFrame([(i, t, 1, None) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int, bucket string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, work(spark)).collect()}
    gone = line_groups(texts)
    assert {(1, 0), (3, 2), (7, 0), (9, 0)} <= gone
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i]["text"] == kept and got[i]["n_removed"] == sum(g[0] == i for g in gone) and got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
    assert line_dedup.dedup_lines(df.limit(0), work(spark)).count() == 0
    # a null key is before all others; rows equal in key and text keep and lose the same lines
    odd = spark.createDataFrame([(5, base[0]), (None, base[0]), (7, base[1]), (7, base[1]), (9007199254740993, base[1])], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.dedup_lines(odd, work(spark)).collect()))
    assert rows == [(0, 0), (5, 1), (7, 0), (7, 0), (9007199254740993, 1)]


def test_line_dedup_recall_on_a_group_of_near_copies(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghklmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    base = rng.choices(words, k=50)
    texts = []
    for _ in range(90):  # edits of 2 to 6 words each way: some pairs link, others only through the rest
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices(words, k=50)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], 0) for r in line_dedup.dedup_lines(df, work(spark)).collect() if r["n_removed"]}
    want = line_groups(texts)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60


def test_line_dedup_finds_edited_lines(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    lines = []
    for i in range(120):  # one word or one letter, in lines of 6 to 40 words
        w = rng.choices(words, k=6 + i % 35)
        e, at = list(w), rng.randrange(len(w))
        e[at] = rng.choice(words) if i % 3 == 0 else e[at][:-1] + "x"
        if i % 3 == 1:
            e.insert(rng.randrange(len(e)), "q")
        lines += [" ".join(w), " ".join(e)]
    lines = [x for x in dict.fromkeys(lines)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r["doc_id"], 0) for r in line_dedup.dedup_lines(df, work(spark)).collect() if r["n_removed"]}
    want = line_groups(lines)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


def lines_of_one_large_bucket(spark, families):
    """Pairs of lines, each with half its words in common with all others, in one block, and edits in three words of the other block."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("klmnoprst") for _ in range(12))
    words = [word() for _ in range(60 * families)]
    words += [w[:-1] + "x" for w in words]
    second = {r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").where("xxhash64(w) < 0").collect()}
    common = [w for w in words if w not in second][:5]
    edited = [w for w in words if w in second and w[:-1] + "x" in second and not w.endswith("x")]
    lines = []
    for i in range(families):
        own = edited[5 * i : 5 * i + 5]
        lines += [" ".join(common + own), " ".join(common + own[:2] + [w[:-1] + "x" for w in own[2:]])]
    return lines


@pytest.mark.parametrize("dealt", [4096, 8])
def test_line_dedup_links_lines_that_share_one_large_bucket(spark, monkeypatch, dealt):
    monkeypatch.setattr(line_dedup, "_DEALT", dealt, raising=False)
    lines = lines_of_one_large_bucket(spark, 12)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r["doc_id"], 0) for r in line_dedup.dedup_lines(df, work(spark)).collect() if r["n_removed"]}
    assert got == line_groups(lines) == {(2 * i + 1, 0) for i in range(12)}


def test_pipeline_links_lines_that_share_one_large_bucket(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    lines = lines_of_one_large_bucket(spark, 12)
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "doc_id long, text string, n_chars long")
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in pipeline.line_dedup_texts(spark, df, "").collect()}
    assert got == {(i, x if i % 2 == 0 else "", len(x) if i % 2 == 0 else 0) for i, x in enumerate(lines)}


def test_letters_never_keep_linked_lines_apart(spark):
    rng = random.Random(23)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("eeettaoin shrdlu zé日7") for _ in range(rng.randint(1, 300)))
        b = list(a)
        for _ in range(len(a) // 10):  # as many edits as a link allows, many of one kind
            at = rng.randrange(len(b))
            kind = rng.choice(["add", "drop", "put"]) if i % 2 else ["add", "drop", "put"][i // 2 % 3]
            b[at : at + 1] = {"add": [b[at], rng.choice("ez日")], "drop": [], "put": [rng.choice("ez日")]}[kind]
        rows.append((a, "".join(b)))
    rows += [("e" * 7, "t" * 7), ("the rain in spain" * 3, "quick brown foxes go" * 3)]
    df = spark.createDataFrame(rows, "a string, b string").select("*", F.length("a").alias("n"), F.length("b").alias("m"))
    df = df.select("*", F.array(*line_dedup._counts(F.col("a"))).alias("x"), F.array(*line_dedup._counts(F.col("b"))).alias("y"))
    flat = df.select("n", "m", *[F.col(c)[i].alias(f"{c}{i}") for c in "xy" for i in range(3)])
    alike = line_dedup._alike("n", "m", ["x0", "x1", "x2"], ["y0", "y1", "y2"], 0.9)
    got = [r["ok"] for r in flat.select(alike.alias("ok")).collect()]
    linked = [lev(a, b) <= math.floor(0.1 * max(len(a), len(b)) + 1e-9) for a, b in rows]
    assert sum(linked) >= 250 and all(ok for ok, link in zip(got, linked, strict=True) if link) and got[-2:] == [False, False]


def test_letters_keep_lines_apart_that_differ_much_in_one_letter_or_in_rare_ones(spark):
    rows = [("e" * 40 + "t" * 24, "e" * 24 + "t" * 40), ("q" * 30, "j" * 30 + "z" * 8), ("日" * 40, "e" * 40), ("h" * 60, "h" * 64), ("é" * 50 + "eta", "é" * 54 + "et")]
    df = spark.createDataFrame(rows, "a string, b string").select("*", F.length("a").alias("n"), F.length("b").alias("m"))
    names = line_dedup._COUNTS
    for x in "ab":
        df = df.select("*", *[c.alias(f"{name}_{x}") for c, name in zip(line_dedup._counts(F.col(x)), names, strict=True)])
    alike = line_dedup._alike("n", "m", [f"{c}_a" for c in names], [f"{c}_b" for c in names], 0.9)
    assert [r["ok"] for r in df.select(alike.alias("ok")).collect()] == [False, False, False, True, True]


def test_rest_pairs_come_once_however_many_buckets_they_share(spark):
    lines = [" ".join(["same words in all of them", "abcdefghijkl"[i : i + 2], "again and again"]) for i in range(9)]
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, norm string").select("line", "norm", *line_dedup._counts(F.col("norm")))
    held = {10: range(9), 20: range(3, 9), 30: (0, 4, 8)}
    rows = [(b, i, len(of), len(lines[i]), i // 2) for b, of in held.items() for i in of]
    mixed = spark.createDataFrame(rows, "bucket long, line long, lines long, size int, label long")
    found = line_dedup._rest_pairs(mixed, texts, 0.9)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == [(a, b) for a in range(9) for b in range(a + 1, 9) if a // 2 != b // 2]
    # the join makes each once: nothing after it takes repeated pairs away
    assert "Distinct" not in found._jdf.queryExecution().logical().toString().split("Join")[0]


def test_very_long_lines_are_cut_at_words_of_equal_counts(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("klmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(30)]
    base = words * 15
    some = [w if i % 9 else w[:-1] + "x" for i, w in enumerate(base)]  # few letters in many places
    far = [w if i % 4 else "x" * len(w) for i, w in enumerate(base)]
    turned = base[200:] + base[:200]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, some, far, turned, base[:-20], base[:60] + words[:2] + base[60:]])]
    texts = spark.createDataFrame(rows, "line long, norm string").select("line", "norm", *line_dedup._counts(F.col("norm")))
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    got = {tuple(r) for r in line_dedup._verified(spark.createDataFrame(pairs, "a long, b long"), texts, 0.9).collect()}
    x = dict(rows)
    whole = spark.createDataFrame([(a, b, x[a], x[b]) for a, b in pairs], "a long, b long, x string, y string").select("a", "b", F.levenshtein("x", "y").alias("d"))
    want = {(a, b) for a, b, d in whole.collect() if d <= math.floor(0.1 * max(len(x[a]), len(x[b])) + 1e-9)}
    assert min(len(t) for t in x.values()) > line_dedup._PLAIN and got == want and {(0, 1), (0, 4), (0, 5)} <= want and (0, 2) not in want


def test_null_keys_leave_other_keys_as_they_are(spark):
    big = [9007199254740993, 9007199254740992]
    df = spark.createDataFrame([(None, "one two three four five six"), (big[0], "seven eight nine ten eleven twelve"), (big[1], "a b c d e f <|endoftext|> g")], "doc_id long, text string").coalesce(1)
    want = {None, *big}
    assert {r["doc_id"] for r in attribution.token_counts(df, RANKS).collect()} == want
    assert {r["doc_id"] for r in spm_bpe.encode_documents(df, RANKS).collect()} == want
    assert {r["doc_id"] for r in packing.pack_documents(df, work(spark), RANKS).collect()} == want
    near = chosen_path.near_duplicates(df, work(spark)).collect()
    assert {r["doc_id"] for r in near} == want and {r["component_id"] for r in near} == want and all(r["kept"] for r in near)
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (big[0], [0.0, 1.0]), (big[1], [-1.0, 0.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert {(r["vec_id"], r["component_id"]) for r in flat_graph.near_vectors(vectors, work(spark)).collect()} == {(None, None), *((b, b) for b in big)}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    names = {r["record_id"] for r in warc.read_archives(warc.write_archives(pages, work(spark))).collect()}
    assert {f"<urn:row:{b}>" for b in big} <= names and len(names) == 3


def test_attribution_by_line_is_brute_force(spark, docs, texts):
    enc = tk()
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in attribution.token_counts(docs, RANKS).collect()}
    for i, t in enumerate(texts[:40] + texts[-10:-2]):
        i = texts.index(t)
        t = t or ""
        if not t.isascii():
            continue
        bounds, at = [], 0
        for line in t.split("\n"):
            bounds.append((at, at + len(line) + 1))
            at += len(line) + 1
        want, crossing, at = Counter(), Counter(), 0
        for token in enc.encode_ordinary(t):
            n = len(enc.decode_single_token_bytes(token))
            held = [max(0, min(at + n, b) - max(at, a)) for a, b in bounds]
            want[held.index(max(held))] += 1
            for k, h in enumerate(held):
                crossing[k] += h > 0 and sum(x > 0 for x in held) > 1
            at += n
        assert all(got[i, k] == (want[k], crossing[k]) for k in range(len(bounds)))


def test_weighted_sampling(spark, docs, texts):
    got = {r["doc_id"]: r for r in weighted_sampling.fingerprints(docs, bucket_rows=16).collect()}
    ts = [t or "" for t in texts]

    def weights(t):
        return Counter(t.split())

    def jaccard(a, b):
        a, b = weights(a), weights(b)
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    errors = []
    for i, t in enumerate(ts):
        half = len(t) // 2
        edited = t[: len(t) - half] + ts[(i + 1) % len(ts)][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        errors.append(got[i]["near_edited"] - jaccard(t, edited))
        errors.append(got[i]["near_next"] - jaccard(t, ts[(i + 1) % len(ts)]))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.1
    assert got[0]["fingerprint"] == got[len(texts) - len(ODD) - 5]["fingerprint"]
    one = weighted_sampling.fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0]
    assert (one["fingerprint"], one["near_next"], one["n_chars"]) == ("empty", 1.0, 0)
    assert weighted_sampling.fingerprints(docs.limit(0)).count() == 0


def test_weighted_sampling_takes_64_samples(spark, docs, texts):
    errors = []
    for r in weighted_sampling.fingerprints(docs, bucket_rows=16).collect():
        assert r["fingerprint"] == "empty" or len(r["fingerprint"]) == 4 * 64
        i = r["doc_id"]
        a, b = Counter((texts[i] or "").split()), Counter((texts[(i + 1) % len(texts)] or "").split())
        true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
        assert abs(r["near_next"] * 64 - round(r["near_next"] * 64)) < 1e-9
        errors.append(r["near_next"] - true)
    assert np.sqrt(np.mean(np.square(errors))) < 0.0625  # the standard error at similarity 0.5


def test_packing(spark, docs, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, work(spark), RANKS, length=256, group_size=40).collect()
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert r["length"] == 256 or k == 0
            at += r["length"]
        assert at == len(ids)
    for inside in places.values():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= 256
    sizes = np.array([r["length"] for r in rows])
    assert len(places) <= 1.05 * sizes.sum() / 256 + 4
    assert packing.pack_documents(docs.limit(0), work(spark), RANKS).count() == 0


def test_local_search_only_improves():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 700, 60)
        start = packing.best_fit(sizes, 1000)
        end = packing.local_search(start, sizes, 1000)
        assert sorted(i for b in end for i in b) == list(range(60)) and len(end) <= len(start) and max(sizes[b].sum() for b in end) <= 1000


def test_local_search_goes_on_while_it_helps():
    assert packing.GROUP >= 16_384
    for seed, bins in ((1, 212), (2, 209), (8, 212)):  # 24 partners, 12 rounds and 48 pieces end one or two bins above
        sizes = np.random.default_rng(seed).integers(100, 600, 600)
        assert len(packing.pack(sizes, 1000)) <= bins


def test_warc(spark):
    rng = random.Random(4)
    big = ["".join(rng.choice("abcdef <>\n") for _ in range(n)) for n in (1000, 2500, 999)]
    pages = [(i, f"http://x/{i} \n", big[i % 3]) for i in range(12)] + [(20, None, None), (21, "u", ""), (None, "u", big[0]), (22, "é", "é" * 500)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, bytes string").repartition(3)
    files = warc.write_archives(df, work(spark))
    whole = {(r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_archives(files).collect()}
    assert len(whole) == len(pages)
    for split in (200, 777):  # records are found and owned once at any split
        found = [(r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_archives(files, split=split).collect()]
        assert len(found) == len(pages) and set(found) == whole
    by_id = {r[0]: r for r in whole}
    for i, _, html in pages:
        if i is None:
            continue
        data = (html or "").encode()
        last = max(k for k, _, h in pages if k is not None and (h or "") == (html or ""))
        wanted = ("revisit", f"<urn:row:{last}>") if len(data) >= 1000 and last != i else ("response", None)
        r = by_id[f"<urn:row:{i}>"]
        assert (r[1], r[4]) == wanted and r[2:4] == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.read_archives(warc.write_archives(df.limit(0), work(spark))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = np.vstack([rng.normal(size=(150, 16))] + [c + rng.normal(scale=0.12, size=(20, 16)) for c in centres])
    x[5] = x[6]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None, *[0.0] * 14], [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    near[5, 6] = near[6, 5] = True
    np.fill_diagonal(near, False)
    label = components(len(x), list(zip(*np.nonzero(near))))
    for block in (1024, 64):
        got = {r["vec_id"]: r for r in flat_graph.near_vectors(df, work(spark), block=block).collect()}
        n = np.array([got[i]["n_links"] for i in range(len(x))])
        assert (n <= near.sum(1)).all() and n.sum() >= 0.95 * near.sum()
        assert [got[i]["component_id"] for i in range(len(x))] == label
        assert [got[1000 + i]["n_links"] for i in range(6)] == [0, 0, 0, 0, 1, 1]
        assert got[0]["audit_recall"] >= 0.9
    assert flat_graph.near_vectors(df.limit(0), work(spark)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=40)
        toxic = i % 5 == 0
        if toxic:
            text += rng.choices(bad, k=rng.randint(1, 4))
        rows.append((i, " ".join(text)))
        if i < 400:
            labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (None, None), (700, "")], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), least_z=5)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("rejected", F.lit("x")), model).collect()}
    assert all(got[i]["rejected"] == (i % 5 == 0) for i in range(400, 600))
    assert not got[700]["rejected"] and got[700]["expected_severity"] >= 0
    severity = lambda t: toxicity.score(spark.createDataFrame([(t,)], "text string"), model).first()["expected_severity"]
    assert severity("w1") < severity("w1 vile") < severity("w1 vile nasty foul")
    blank = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r["rejected"] for r in toxicity.score(df, blank).collect())


def test_importance(spark):
    rng = random.Random(8)
    good, junk = [f"g{i}" for i in range(80)], [f"j{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(junk if i % 4 == 0 else good, k=30))) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = importance.log_ratios(df, df.where("doc_id % 4 = 1").select(F.col("doc_id").alias("_good")))
    scored = importance.score(df, ratios)
    values = {r["doc_id"]: r for r in scored.collect()}
    counts = Counter(b for _, t in rows for b in importance.ngram_buckets(t).tolist())
    assert {r["bucket"]: r["n"] for r in importance.bucket_counts(df).collect()} == counts
    assert all((values[i]["log_weight"] > 0) == (i % 4 != 0) for i in range(200)) and values[500]["log_weight"] == 0
    keyed = scored.withColumn("key", importance.sample_key())
    keys = sorted((r["key"] for r in keyed.collect()), reverse=True)
    for k in (1, 7, 150, 202):
        assert importance.kth_largest(keyed, "key", k, fan=8) == keys[k - 1]
    assert importance.kth_largest(keyed, "key", 203) is None and importance.sampling_threshold(scored, 0) == float("inf")
    cut = importance.calibrate(scored, df.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality")))
    assert values[0]["mean_log_ratio"] < cut < values[1]["mean_log_ratio"]


def test_importance_weights_are_the_models_ratios(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=12))) for i in range(60)]
    rows += [(3, "aa aa"), (None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(None, 1), (0, 1)], "doc_id long, quality int")
    keys = importance.target_keys(labels)
    assert sorted(r[0] for r in keys.collect()) == list(range(0, 30, 3)) and importance.target_keys(labels, max_target=4).count() == 4
    buckets, raw, good = 64, np.zeros(64), np.zeros(64)
    for k, t in rows:
        for b in importance.ngram_buckets(t, buckets):
            raw[b] += 1
            good[b] += k is not None and k < 30 and k % 3 == 0
    halves = lambda c: np.concatenate([h / h.sum() for h in c.reshape(2, -1)])
    prior = halves(raw + 0.5)
    want = np.log(halves(good + prior * 0.5 * buckets + 1e-9)) - np.log(prior)
    ratios = importance.log_ratios(df, keys, buckets=buckets)
    assert np.allclose(ratios, want)
    scored = importance.score(df, ratios).withColumn("key", importance.sample_key())
    least = importance.sampling_threshold(scored, 10)
    found = scored.collect()
    for r, (_, t) in zip(sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])), sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))):
        assert r["log_weight"] == pytest.approx(sum(want[b] for b in importance.ngram_buckets(t, buckets)))
    assert sorted((r["key"] for r in found), reverse=True)[9] == least and sum(r["key"] >= least for r in found) == 10


def test_gumbel_draws_in_proportion_to_weights(spark):
    two = spark.range(4000).withColumn("n_grams", F.lit(1)).withColumnRenamed("id", "doc_id")
    pairs = two.withColumn("log_weight", F.lit(0.0)).withColumn("a", importance.sample_key()).withColumn("log_weight", F.log(F.lit(3.0))).withColumn("b", importance.sample_key(seed=18))
    assert 0.70 < pairs.where("b > a").count() / 4000 < 0.80

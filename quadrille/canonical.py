"""RDFC-1.0: canonical labels for blank nodes.

First-degree hashes are DataFrame work; only nodes whose hash is shared need the
N-degree algorithm, which runs on the driver over the quads around them and is limited.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CALLS = 1000


class TooAmbiguous(RuntimeError):
    pass


def _line(s, p, o, g) -> str:
    return " ".join(x for x in (s, p, o, g) if x) + " .\n"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def first_degree(quads: DataFrame) -> DataFrame:
    """(node, hash) of every blank node."""
    nodes = quads.withColumn("node", F.explode(F.array_distinct(F.filter(F.array("s", "o", "g"), lambda x: x.startswith("_:"))))).where("node is not null")

    def shown(c: str):
        return F.when(F.col(c) == F.col("node"), "_:a").when(F.col(c).startswith("_:"), "_:z").otherwise(F.col(c))

    lines = nodes.select("node", F.concat(F.concat_ws(" ", *map(shown, "spog")), F.lit(" .\n")).alias("line"))
    return lines.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256).alias("hash"))


def labels(quads: DataFrame) -> dict[str, str]:
    """Canonical labels of the blank nodes of a graph that fits the driver; as the standard defines them."""
    rows = [tuple(r) for r in quads.select("s", "p", "o", "g").distinct().collect()]
    around: dict[str, list[tuple]] = {}
    for q in rows:
        for x in {q[0], q[2], q[3]}:
            if x and x.startswith("_:"):
                around.setdefault(x, []).append(q)
    first = {r["node"]: r["hash"] for r in first_degree(quads).collect()}
    by_hash: dict[str, list[str]] = {}
    for node, h in first.items():
        by_hash.setdefault(h, []).append(node)
    canonical: dict[str, str] = {}

    def issue(names: dict[str, str], prefix: str, node: str) -> str:
        return names.setdefault(node, f"_:{prefix}{len(names)}")

    for h in sorted(by_hash):
        if len(by_hash[h]) == 1:
            issue(canonical, "c14n", by_hash[h][0])
    calls = 0

    def related(node: str, q: tuple, names: dict[str, str], place: str) -> str:
        name = canonical.get(node) or names.get(node) or first[node]
        return _sha(place + (q[1] if place != "g" else "") + name)

    def n_degree(node: str, names: dict[str, str]) -> tuple[str, dict[str, str]]:
        nonlocal calls
        calls += 1
        if calls > MOST_CALLS:
            raise TooAmbiguous("too many blank nodes look alike")
        groups: dict[str, list[str]] = {}
        for q in around[node]:
            for place, x in (("s", q[0]), ("o", q[2]), ("g", q[3])):
                if x and x.startswith("_:") and x != node:
                    groups.setdefault(related(x, q, names, place), []).append(x)
        data = ""
        for h in sorted(groups):
            data += h
            chosen, chosen_names = "", names
            for order in permutations(groups[h]):
                copy, path, later = dict(names), "", []
                for x in order:
                    if x in canonical:
                        path += canonical[x]
                    else:
                        if x not in copy:
                            later.append(x)
                        path += issue(copy, "b", x)
                    if chosen and len(path) >= len(chosen) and path > chosen:
                        break
                else:
                    for x in later:
                        result, copy_after = n_degree(x, copy)
                        path += issue(copy, "b", x) + f"<{result}>"
                        copy = copy_after
                    if not chosen or path < chosen:
                        chosen, chosen_names = path, copy
            data += chosen
            names = chosen_names
        return _sha(data), names

    for h in sorted(by_hash):
        if len(by_hash[h]) > 1:
            results = []
            for node in by_hash[h]:
                if node not in canonical:
                    names: dict[str, str] = {}
                    issue(names, "b", node)
                    results.append(n_degree(node, names))
            for _, names in sorted(results, key=lambda r: r[0]):
                for node in names:
                    issue(canonical, "c14n", node)
    return canonical


def canonical_nquads(quads: DataFrame) -> str:
    names = labels(quads)
    lines = {_line(*[names.get(x, x) for x in r]) for r in quads.select("s", "p", "o", "g").collect()}
    return "".join(sorted(lines))


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    return canonical_nquads(a) == canonical_nquads(b)

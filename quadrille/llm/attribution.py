"""Token counts by section through character offsets (operator 2).

Each document is encoded once, whole.  Every token has a character span; the spans are
joined with the spans of the document's sections, and a token that meets several
sections goes to one of them, or is shared, by a stated rule:

``majority``  the section that holds most of its characters, the earlier one on a tie;
``start``     the first section that holds its first character, else the first it meets;
``share``     every section it meets, in proportion to the characters held.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.bpe import rank_encoding

RULES = ("majority", "start", "share")
SECTIONS = "array<struct<section long, start long, end long, n_tokens double, n_crossing long>>"


class SpanEncoder:
    """The character spans of a text's tokens.

    A token that ends inside a character (a byte-level token may) reaches to that
    character's end, and the next token starts at its beginning: both hold it.
    """

    def __init__(self, path: str):
        self.encoding = rank_encoding(path)
        self.sizes = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)], dtype=np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = self.encoding.encode_ordinary(text)
        sizes = self.sizes[np.fromiter(tokens, dtype=np.int64, count=len(tokens))]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if len(ends) and ends[-1] != len(text):  # some characters take several bytes
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of every byte
            starts, ends = at[starts], at[ends - 1] + 1
        return starts, ends


@lru_cache(maxsize=2)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def join_spans(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of token spans, sorted, with section spans: token, section and characters shared of each meeting pair."""
    first = np.searchsorted(ends, low, side="right")
    last = np.searchsorted(starts, high, side="left")
    counts = np.maximum(last - first, 0) * (high > low)
    section = np.repeat(np.arange(len(low)), counts)
    token = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    shared = np.minimum(ends[token], high[section]) - np.maximum(starts[token], low[section])
    return token, section, shared


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """By section the tokens allocated and the tokens it shares with others; and the tokens in no section."""
    token, section, shared = join_spans(starts, ends, low, high)
    met = np.bincount(token, minlength=len(starts))
    crossing = np.bincount(section[met[token] > 1], minlength=len(low))
    if rule == "share":
        whole = np.bincount(token, weights=shared, minlength=len(starts))
        given = np.bincount(section, weights=shared / whole[token], minlength=len(low)) if len(token) else np.zeros(len(low))
    else:
        worth = shared if rule == "majority" else (low[section] <= starts[token]).astype(int)
        order = np.lexsort((section, -worth, token))
        best = order[np.concatenate([[True], np.diff(token[order]) > 0])] if len(order) else order
        given = np.bincount(section[best], minlength=len(low)).astype(float)
    return given, crossing, int((met == 0).sum())


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with its line end; they cover the text without gaps."""
    sizes = np.fromiter(map(len, text.split("\n")), dtype=np.int64)
    sizes[:-1] += 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens by document and section: key, section, start, end, n_tokens, n_crossing.

    ``sections`` names a column of type array<struct<start, end>> of character spans, in
    any order, that may leave gaps or overlap; without it the sections are the text's
    lines.  Spans are cut to the text; null, empty or reversed ones hold no tokens.
    Tokens in no section come as a row of section -1 when there are any.  A null or empty
    text has one empty section when sections are lines.  Strings of special tokens are
    ordinary text.  Repeated rows give repeated
    results, an empty table an empty one; other columns of ``docs`` are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(value: str | None, spans) -> list[tuple]:
        value = value or ""
        if sections:
            cut = [((s or {}).get("start"), (s or {}).get("end")) for s in (spans if spans is not None else [])]
            both = np.array([(0, 0) if a is None or b is None else (a, b) for a, b in cut], dtype=np.int64).reshape(-1, 2)
            low, high = np.clip(both[:, 0], 0, len(value)), np.clip(both[:, 1], 0, len(value))
        else:
            low, high = line_sections(value)
        given, crossing, outside = allocate(*span_encoder(vocabulary).spans(value), low, high, rule)
        rows = list(zip(range(len(low)), low.tolist(), high.tolist(), given.tolist(), crossing.tolist()))
        return rows + [(-1, 0, 0, float(outside), 0)] if outside else rows

    # keys stay out of Python, so a null key can't change the kind of the others
    @F.pandas_udf(SECTIONS)
    def counts(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([count(value, s) for value, s in zip(texts, spans)])

    rows = docs.select(F.col(key).alias("_key"), F.explode(counts(F.col(text), F.col(sections) if sections else F.lit(None).cast("string"))).alias("_s"))
    return rows.select(F.col("_key").alias(key), "_s.*")

"""Byte-level BPE through sentencepiece (operator 7).

A sentencepiece BPE model is serialised straight from the ranks of a byte-level
vocabulary: each piece is the vocabulary's byte string with every byte written as one
printable character, its score is its negative rank, and normalisation is the identity.
Pre-tokens are mapped the same way and encoded; decoding maps pieces back to bytes.
Nothing is trained.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.bpe import ChunkEncoder, read_ranks
from quadrille.llm.common import own_name

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1  # negative numbers take the two's complement of 64 bits
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


#: Fixed values of sentencepiece's model format: field numbers, and the types used.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
TRAINER_MODEL_TYPE, TRAINER_VOCAB_SIZE, TRAINER_UNK, TRAINER_BOS, TRAINER_EOS, TRAINER_PAD = 3, 4, 40, 41, 42, 43
MODEL_TYPE_BPE = 2
NORMALIZER_NAME, NORMALIZER_DUMMY_PREFIX, NORMALIZER_EXTRA_SPACES, NORMALIZER_ESCAPE_SPACES = 1, 3, 4, 5


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto whose piece ids are the ranks; the id after the last rank is <unk>."""
    chars, by_rank = byte_characters(), sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [(("".join(chars[b] for b in p)).encode(), -float(r), TYPE_NORMAL) for r, p in enumerate(by_rank)]
    pieces.append((b"<unk>", 0.0, TYPE_UNKNOWN))
    out = [
        _block(PIECES, _block(PIECE_TEXT, text) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score) + _number(PIECE_TYPE, kind))
        for text, score, kind in pieces
    ]
    trainer = _number(TRAINER_MODEL_TYPE, MODEL_TYPE_BPE) + _number(TRAINER_VOCAB_SIZE, len(pieces)) + _number(TRAINER_UNK, len(by_rank))
    trainer += _number(TRAINER_BOS, -1) + _number(TRAINER_EOS, -1) + _number(TRAINER_PAD, -1)
    normalizer = _block(NORMALIZER_NAME, b"identity") + _number(NORMALIZER_DUMMY_PREFIX, 0) + _number(NORMALIZER_EXTRA_SPACES, 0) + _number(NORMALIZER_ESCAPE_SPACES, 0)
    return b"".join(out) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class SentencePieceBpe:
    """Encoder and decoder of whole texts."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.pre = regex.compile(pattern)
        self.chars = byte_characters()
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        self.chunks = ChunkEncoder(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.pre.findall(chunk):
            # one pre-token of many characters is still one call, so its cost stays n log n
            ids += self.model.encode("".join(map(self.chars.__getitem__, piece.encode())))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.chunks.bytes_of(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> SentencePieceBpe:
    return SentencePieceBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every row of ``docs`` with its token count, digests of ids and of decoded bytes.

    A null text counts as empty: no ids, digests of nothing.  A text of any length is
    encoded whole.  Repeated rows give repeated results.  ``docs`` keeps its other
    columns; a column of a name added here is replaced.  ``keep_ids`` adds ``ids``, the
    array of token ids.  An empty table gives an empty table.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * keep_ids
    kept = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in {*names, "ids"} and c != text]

    # only texts go to Python, so a null elsewhere can't change the kind of a number
    @F.pandas_udf(f"struct<{SCHEMA}{', ids array<long>' if keep_ids else ''}>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = codec(vocabulary), []
        for value in texts:
            ids = bpe.encode(value or "")
            back = bpe.decode(ids)
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == (value or "").encode(), *([ids.tolist()] if keep_ids else [])))
        return pd.DataFrame(rows, columns=names)

    found = own_name(docs, "_found")
    return docs.withColumn(found, encode(F.col(text))).select(*map(F.col, kept), *[F.col(f"{found}.{n}").alias(n) for n in names])

"""Byte-level BPE over whole texts, chunk by chunk, with a bounded memory of chunks.

A text is cut before every single space that stands between two characters that are not
white space.  The pre-token pattern of byte-level BPE never matches across such a place,
so the chunks' ids, joined, are the text's ids, and common chunks are encoded once.
Texts with other runs of white space are cut into pre-tokens by the pattern itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken

#: Chunks that one Python worker remembers, and the longest of them.
REMEMBERED, LONGEST = 250_000, 48
_RUNS = re.compile(r" \s|\s ")
_PRE = regex.compile(public_tokenizers.PATTERN)


class ChunkMemory(dict):
    """chunk -> encode(chunk); forgets everything when it is full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found


class ChunkEncoder:
    """Turns a text into the encodings of its chunks; ``encode`` gives one chunk's."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.plain = ChunkMemory(encode)
        self.spaced = ChunkMemory(lambda chunk: encode(f" {chunk}"))

    def parts(self, text: str) -> tuple[list[str], bool]:
        """The chunks, and whether a space was removed before each but the first."""
        if _RUNS.search(text):
            return _PRE.findall(text), False
        return text.split(" "), True

    def encoded(self, parts: list[str], spaced: bool) -> Iterable[bytes]:
        if not spaced:
            return map(self.plain.__getitem__, parts)
        return [self.plain[parts[0]], *map(self.spaced.__getitem__, parts[1:])]

    def bytes_of(self, text: str) -> bytes:
        return b"".join(self.encoded(*self.parts(text)))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


#: The string of the vocabulary's end-of-text token, whose id is the one after the last rank.
END_OF_TEXT = "<|endoftext|>"


@lru_cache(maxsize=4)
def special_encoding(path: str) -> tiktoken.Encoding:
    ranks = read_ranks(path)
    return tiktoken.Encoding("ranks and end", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def encoded(path: str, text: str) -> list[int]:
    """The ids that the tokenizers library gives by default: the end-of-text string is one token."""
    if END_OF_TEXT in text:
        return special_encoding(path).encode(text, allowed_special={END_OF_TEXT}, disallowed_special=())
    return rank_encoding(path).encode_ordinary(text)

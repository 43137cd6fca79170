"""Ranks of a public byte-level BPE vocabulary, loaded once per Python worker from a given file."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import tiktoken

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def ranks(path: str = BYTE_BPE) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str = BYTE_BPE, pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def single(path: str = BYTE_BPE) -> tiktoken.Encoding:
    """The vocabulary without a pattern: a string is one piece."""
    return tiktoken.Encoding(path, pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})

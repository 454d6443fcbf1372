"""Whole-text pre-tokenization shared by the byte-level BPE operators, and the vocabulary file behind it.

A text is cut at single spaces first. Where no white space stands beside a space, a piece with its leading space
splits into the same matches alone as in the text, so a piece is split once by the pattern and then looked up.
Texts with other white space beside a space are split by the pattern as a whole.
"""

from __future__ import annotations

import base64
import functools
import re
import regex

#: The pattern of the public rank files: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile(r"[^\S \n]").search
_BESIDE = regex.compile(r"\s | \s").search


def default_vocabulary() -> str:
    """The path of the public multilingual rank file, if its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoder(path: str):
    """bytes of one pre-token -> ids, for the rank file at path."""
    import tiktoken

    own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return own._encode_single_piece


@functools.lru_cache(1)
def pattern():
    return regex.compile(PATTERN)


def matches():
    return pattern().findall


class Memo(dict):
    """A dict that makes missing values, and forgets all when it has limit of them."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def pieces(text: str) -> tuple[str, list[str]] | None:
    """The first piece, and the others without their leading space; None where such a cut could change the matches of PATTERN."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or (_OTHER(text) and _BESIDE(text)):
        return None
    first, *rest = text.split(" ")
    return first, rest


def words_after_space(piece: str) -> list[str]:
    """The matches of PATTERN in a space and a piece. Plain words, alone or with one mark behind them, need no search."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1:] in _MARKS and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return matches()(" " + piece)


_MARKS = frozenset(".,;:!?")

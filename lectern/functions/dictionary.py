"""Segmentation by a dictionary: forward maximum match in a trie, for dictionaries too large for a pattern.

Reading from the left, the longest dictionary word that starts at a place is taken whole; where none does, the longest run of digits,
or of letters other than CJK, or one CJK character. A word that starts or ends in a letter or digit other than CJK doesn't start or end
within a run of them. Time goes with the text's length and the longest word's, not with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK

_RUN = regex.compile(rf"[{CJK}]|[0-9]+|[\p{{L}}--[{CJK}]]+", regex.V1)
_INNER = regex.compile(rf"[\p{{L}}\p{{N}}--[{CJK}]]", regex.V1)
_EDGE = regex.compile(rf"[\w--[{CJK}]]", regex.V1)
_END = ""


@lru_cache(maxsize=1 << 16)
def _inner(char: str) -> bool:
    return _INNER.match(char) is not None


class Dictionary:
    """A trie of lower-case words: each character leads to the next node, the empty string marks a word's end."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in {w.lower() for w in words} - {""}:
            node = self.root
            for char in word:
                node = node.setdefault(char, {})
            # whether what stands before and after must not be a letter or digit
            node[_END] = (_EDGE.match(word[0]) is not None, _EDGE.match(word[-1]) is not None)

    def longest(self, text: str, at: int) -> int:
        """Where the longest word that starts at ``at`` ends; ``at`` if none does."""
        node, end, best = self.root.get(text[at]), at + 1, at
        free = at == 0 or not _inner(text[at - 1])
        while node is not None:
            if (edges := node.get(_END)) and (free or not edges[0]) and not (edges[1] and end < len(text) and _inner(text[end])):
                best = end
            if end == len(text):
                break
            node, end = node.get(text[end]), end + 1
        return best

    def cut(self, text: str) -> list[str]:
        """The tokens of a lower-case text."""
        out, at, root, size = [], 0, self.root, len(text)
        while at < size:
            if text[at] in root and (end := self.longest(text, at)) > at:
                out.append(text[at:end])
                at = end
            elif found := _RUN.match(text, at):
                out.append(found[0])
                at = found.end()
            else:
                at += 1
        return out

    def holds(self, text: str) -> bool:
        """Whether any word stands anywhere in a lower-case text, within runs or not."""
        for at, char in enumerate(text):
            node, end = self.root.get(char), at + 1
            while node is not None:
                if _END in node:
                    return True
                node, end = (node.get(text[end]), end + 1) if end < len(text) else (None, end)
        return False


def cut(text: Column, words: Iterable[str]) -> Column:
    """Tokens (array<string>) of a lower-case text by a dictionary; null for null. The trie is made once per task."""
    listed = sorted(set(words))

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        known = _known(tuple(listed))
        return texts.map(lambda t: None if t is None else known.cut(t))

    return tokens(text)


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a lower-case text holds any of ``words``."""
    listed = sorted(set(words))

    @F.pandas_udf("boolean")
    def held(texts: pd.Series) -> pd.Series:
        known = _known(tuple(listed))
        return texts.map(lambda t: t is not None and known.holds(t))

    return held(text)


@lru_cache(maxsize=4)
def _known(words: tuple[str, ...]) -> Dictionary:
    return Dictionary(words)

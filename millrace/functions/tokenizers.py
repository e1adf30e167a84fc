"""Tokenizers behind one seam: what counts, cuts and joins tokens.

A tokenizer is any object with ``encode`` (text to a list of tokens), ``decode`` (a list of tokens back to text)
and ``count``. Vocabulary files are parameters; libraries that read them are imported when one is opened.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol, runtime_checkable


@runtime_checkable
class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...

    def count(self, text: str) -> int: ...


class Words:
    """Words, each with the white space before it: decoding gives the text back."""

    _piece = re.compile(r"\s*\S+")

    def encode(self, text: str) -> list[str]:
        return self._piece.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens).strip()

    def count(self, text: str) -> int:
        return len(text.split())


class Vocabulary:
    """A tokenizer file in the JSON format of the ``tokenizers`` library. It is opened once a process, so that
    the object itself, which tasks receive, is only a path."""

    def __init__(self, path: str) -> None:
        self.path = path

    def encode(self, text: str) -> list[int]:
        return _opened(self.path).encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return _opened(self.path).decode(tokens)

    def count(self, text: str) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=8)
def _opened(path: str):
    from tokenizers import Tokenizer as Reader

    return Reader.from_file(path)


class Widest:
    """Counts as the tokenizer that needs most tokens, and cuts with the first: text that fits fits all of them."""

    def __init__(self, *members: Tokenizer) -> None:
        if not members:
            raise ValueError("at least one tokenizer is needed")
        self.members = members

    def encode(self, text: str) -> list:
        return self.members[0].encode(text)

    def decode(self, tokens: list) -> str:
        return self.members[0].decode(tokens)

    def count(self, text: str) -> int:
        return max(m.count(text) for m in self.members)


_default: list[Tokenizer] = []


def set_default(tokenizer: Tokenizer | None) -> None:
    """What ``resolve`` gives where nothing is named; None sets it back to words."""
    _default[:] = [tokenizer] if tokenizer else []


def resolve(named: Tokenizer | str | None = None) -> Tokenizer:
    """A tokenizer as it is, one from a vocabulary file's path, or the default."""
    if named is None:
        return _default[0] if _default else Words()
    if isinstance(named, str):
        return Vocabulary(named)
    if not isinstance(named, Tokenizer):
        raise TypeError("a tokenizer has encode, decode and count")
    return named

"""The terms of ``functions.text`` in Python workers: every distinct run of characters is taken apart once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Distinct runs, and terms, that a worker remembers between batches.
REMEMBERED = 250_000
_LOW_UP, _UP_WORD = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z])([A-Z][a-z])")
_ATOM, _PLAIN, _DELIMITED = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.\-]*"), re.compile(r"[A-Z]?[^A-Z._\-]*"), re.compile("[_-]")
_RUN, _MARKS, _DIGITS = re.compile("[0-9A-Za-z_$]+"), re.compile("[_$]+"), re.compile("[0-9]+|[^0-9]+")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _camel(part: str) -> list[str]:
    return _UP_WORD.sub(r"\1 \2", _LOW_UP.sub(r"\1 \2", part)).split(" ")


def code_forms(run: str) -> list[str]:
    """The terms that ``text.code_terms`` has of one ASCII run."""
    atom = run.rstrip(".-")
    if _PLAIN.fullmatch(atom):
        return [atom.lower()]
    every = [atom]
    for s in filter(None, atom.split(".")):
        every.append(s)
        for p in filter(None, _DELIMITED.split(s)):
            every += [p, *_camel(p)]
    return list(dict.fromkeys(t.lower() for t in every))


def hash_forms(run: str) -> list[str]:
    """The terms that ``text.hash_terms`` has of one run."""
    parts = [x for p in _MARKS.split(run) if p for c in _camel(p) for x in _DIGITS.findall(c)]
    return [t.lower() for t in ([run, *parts] if len(parts) > 1 else [run])]


class _Memory(dict):
    """Numbers of the terms of a run, and the terms by number."""

    def __init__(self, forms: Callable[[str], list[str]]):
        super().__init__()
        self.forms, self.known, self.terms = forms, {}, []

    def number(self, term: str) -> int:
        n = self.known.get(term)
        if n is None:
            n = self.known[term] = len(self.terms)
            self.terms.append(term)
        return n

    def __missing__(self, run: str) -> tuple[int, ...]:
        got = self[run] = tuple(map(self.number, self.forms(run)))
        return got

    def trim(self) -> bool:
        """Forgets all once it is full; numbers of before are void then."""
        if max(len(self), len(self.terms)) < REMEMBERED:
            return False
        self.clear()
        self.known.clear()
        self.terms.clear()
        return True


class CodeTerms(_Memory):
    """The terms of a chunk's ASCII text, symbol and callees, as ``sparse.chunk_stream`` has them."""

    def __init__(self):
        super().__init__(code_forms)

    def of(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, _ATOM.findall(text)))) if text else []

    def stream(self, text: str | None, symbol: str | None, calls: list[str | None] | None) -> list[int]:
        got = self.of(text) or [self.number(w) for w in _SPACE.split((text or "").lower()) if w]
        got += self.of(symbol)
        for c in calls or ():
            got += self.of(c)
        return got


class HashTerms(_Memory):
    """The terms of the hash embedder; whatever is not ASCII ends a run."""

    def __init__(self):
        super().__init__(hash_forms)

    def of(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, _RUN.findall(text)))) if text else []


def counted(numbers: list[list[int]], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its distinct terms and how often it has them: rows, terms, counts, in the order of rows."""
    row = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, len(row))
    pair, tf = np.unique(row * max(n_terms, 1) + flat, return_counts=True)
    return pair // max(n_terms, 1), pair % max(n_terms, 1), tf


def spelled(numbers: np.ndarray, terms: list[str]) -> pa.Array:
    """The terms of these numbers."""
    used, at = np.unique(numbers, return_inverse=True)
    return pa.array([terms[n] for n in used], type=pa.string()).take(pa.array(at.astype(np.int64)))

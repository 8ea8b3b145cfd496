"""Normalisation of rule statements shared by the rule operators.

A statement is reduced to plain words, data names (storage prefix plus abbreviated parts), paragraph names
and amounts, so that case, punctuation, number format and quote marks no longer matter.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A data name: two-letter storage prefix and at least two parts, written with hyphens or underscores.
DATA_NAME = r"[a-z]{2}(?:[-_][a-z0-9]+){2,}"
#: A paragraph name: four digits, a verb and an object.
PARAGRAPH = r"\d{4}-[a-z]+(?:-[a-z0-9]+)*"
TOKEN = re.compile(rf"(?P<name>\b{DATA_NAME}\b)|(?P<para>\b{PARAGRAPH}\b)|(?P<num>(?<![a-z0-9])\d[\d,]*(?:\.\d+)?(?![a-z0-9]))|(?P<word>[a-z][a-z0-9]*(?:['-][a-z0-9]+)*)")
#: Unit words that belong to an amount and are dropped with it.
UNITS = frozenset({"usd", "dollars", "dollar", "per", "cent", "percent"})
#: Abbreviations that extractors use, and their full words.
SHORT = {"para": "paragraph", "cust": "customer", "acct": "account", "amt": "amount", "calc": "calculation", "qty": "quantity", "num": "number", "prog": "program", "proc": "procedure", "rec": "record", "tbl": "table", "max": "maximum", "min": "minimum", "addr": "address", "bal": "balance", "val": "value"}


def amount(text: str) -> str:
    """One spelling for one amount: without separators and trailing zero decimals."""
    value = text.replace(",", "")
    return value.rstrip("0").rstrip(".") if "." in value else value


def pieces(raw: str) -> tuple[tuple[str, str], ...]:
    """(kind, value) of the tokens within one space-free lower-case string."""
    out = []
    for m in TOKEN.finditer(raw):
        kind, value = m.lastgroup, m.group()
        if kind == "word":
            if value not in UNITS:
                out.append(("word", SHORT.get(value, value)))
        elif kind == "num":
            out.append((kind, amount(value)))
        else:
            out.append((kind, value.replace("_", "-")))
    return tuple(out)


#: How many different strings a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
_known: dict[str, tuple[tuple[str, str], ...]] = {}


def tokens(text: str | None) -> tuple[list[str], list[str], list[str]]:
    """Plain words and paragraph names in order, data names, and amounts of a text; of null and blank text nothing."""
    words: list[str] = []
    names: list[str] = []
    amounts: list[str] = []
    if not text:
        return words, names, amounts
    into = {"word": words.append, "para": words.append, "name": names.append, "num": amounts.append}
    if len(_known) > REMEMBERED:
        _known.clear()
    for raw in text.lower().split():
        own = _known.get(raw)
        if own is None:
            own = _known[raw] = pieces(raw)
        for kind, value in own:
            into[kind](value)
    return words, names, amounts


_hashed: dict[str, tuple[tuple[int, ...], tuple[str, ...], tuple[str, ...]] | int] = {}


def _hash_pieces(raw: str) -> tuple[tuple[int, ...], tuple[str, ...], tuple[str, ...]] | int:
    own = pieces(raw)
    by = lambda *kinds: tuple(v for k, v in own if k in kinds)
    hashes = tuple(xxhash.xxh32_intdigest(w) for w in by("word", "para"))
    return hashes[0] if len(hashes) == len(own) == 1 else (hashes, by("name"), by("num"))


def hashed_tokens(text: str | None) -> tuple[set[int], list[str], list[str]]:
    """As ``tokens``, the words as a set of 32-bit hashes."""
    words: set[int] = set()
    names: list[str] = []
    amounts: list[str] = []
    if len(_hashed) > REMEMBERED:
        _hashed.clear()
    for raw in (text or "").lower().split():
        own = _hashed.get(raw)
        if own is None:
            own = _hashed[raw] = _hash_pieces(raw)
        if own.__class__ is int:
            words.add(own)
        else:
            words.update(own[0])
            names.extend(own[1])
            amounts.extend(own[2])
    return words, names, amounts


class _Codes(dict):
    """The word hash of each space-free string that is one word, else the complement of its place in ``others``; the mark
    of a text's end is the last place there can be."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.others: list[tuple[tuple[int, ...], tuple[str, ...], tuple[str, ...]]] = []
        self["\x00"] = _END

    def __missing__(self, raw: str) -> int:
        own = _hash_pieces(raw)
        if own.__class__ is int:
            code = own
        else:
            code = ~len(self.others)
            self.others.append(own)
        self[raw] = code
        return code


_END = -(1 << 62)
_codes = _Codes()


def hashed_texts(texts: list[str | None]) -> tuple[np.ndarray, list[int], list[list[str]], list[list[str]]]:
    """``hashed_tokens`` of many texts at once: the word hashes, of each text distinct and in ascending order, where each
    text's end, and the texts' names and amounts."""
    n = len(texts)
    if len(_codes) > REMEMBERED:
        _codes.clear()
    raw = " ".join([f"{(t or '').replace('\x00', ' ')} \x00" for t in texts]).lower().split()
    code = np.fromiter(map(_codes.__getitem__, raw), dtype=np.int64, count=len(raw))
    text = np.cumsum(code == _END)
    names: list[list[str]] = [[] for _ in range(n)]
    amounts: list[list[str]] = [[] for _ in range(n)]
    word = code >= 0
    more: list[int] = []
    other = np.flatnonzero(~word & (code != _END))
    for k, at in zip(text[other].tolist(), (~code[other]).tolist(), strict=True):
        hashes, own_names, own_amounts = _codes.others[at]
        for h in hashes:
            more.append((k << 32) | h)
        if own_names:
            names[k] += own_names
        if own_amounts:
            amounts[k] += own_amounts
    keys = np.sort(np.concatenate([(text[word] << 32) | code[word], np.array(more, dtype=np.int64)]))
    keys = keys[np.diff(keys, prepend=-1) != 0]
    ends = np.searchsorted(keys, np.arange(1, n + 1, dtype=np.int64) << 32)
    return (keys & 0xFFFFFFFF).astype(np.uint32), ends.tolist(), names, amounts

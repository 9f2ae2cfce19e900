"""Which identifiers of a text its source never mentions.

Source and name are brought to one spelling and cut into pieces (words, spaces, single marks); a name is grounded if
its pieces stand in the source side by side, or if it is a date that the source spells out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import identifiers

# Names of months; a source may also write their first three letters, or sept.
MONTHS = "january february march april may june july august september october november december".split()

_MONTH = {form: n for n, name in enumerate(MONTHS, 1) for form in (name, name[:3])} | {"sept": 9}
_PIECES = re.compile(r"\w+|\s|[^\w\s]")
_OWN_HOME = re.compile(r"(?<![\w~])/(?:root|home/[^/\s]+)(?=/)")


class Source(NamedTuple):
    pieces: str
    days: set[tuple[int, int]]
    years: set[str]
    dates: set[str]


def _cut(text: str) -> list[str]:
    """Pieces in one spelling: home folders are ~, and a number has no v before it."""
    pieces = _PIECES.findall(_OWN_HOME.sub("~", text))
    return [p[1:] if p[0] == "v" and p[1:2].isdigit() else p for p in pieces]


def _joined(pieces: list[str]) -> str:
    return "\0" + "\0".join(pieces) + "\0"


def read_source(text: str) -> Source:
    """What a lower-case source mentions: its pieces, days of months, years, and dates in digits."""
    pieces = _cut(text)
    words = [p for p in pieces if p[0].isalnum()]
    days = set()
    for a, b in zip(words, words[1:], strict=False):
        for month, day in ((a, b), (b, a)):
            if month in _MONTH and day.isascii() and day.isdigit() and len(day) <= 2:
                days.add((_MONTH[month], int(day)))
    years = {w[:4] for w in words if w[:4].isdigit()}
    dates = {text[m.start() : m.start() + 10] for m in re.finditer(r"\d{4}-\d\d-\d\d", text)}
    return Source(_joined(pieces), days, years, dates)


def _mentioned(pieces: list[str], source: Source) -> bool:
    """Side by side in the source, and a mark at either end does not touch a word there."""
    joined = _joined(pieces)
    if joined not in source.pieces:
        return False
    before, after = ("" if _is_word(end) else edge for end, edge in ((pieces[0], r"(?<!\w)"), (pieces[-1], r"(?!\w)")))
    return not (before or after) or re.search(before + re.escape(joined) + after, source.pieces) is not None


def _is_word(piece: str) -> bool:
    return re.match(r"\w", piece) is not None


def is_grounded(name: str, source: Source) -> bool:
    """Whether the source mentions a lower-case identifier, give or take a first v or #, a last slash, how a home folder is
    written, or how a date is.
    """
    bare = name.rstrip("/")
    spellings = {tuple(_cut(form)) for form in (bare, bare[1:] if bare[:1] in ("v", "#") else bare)}
    if any(pieces and _mentioned(list(pieces), source) for pieces in spellings):
        return True
    date = name[:10]
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", date) or name[10:11] not in ("", "t"):
        return False
    return date in source.dates or (date[:4] in source.years and (int(date[5:7]), int(date[8:])) in source.days)


def ungrounded(text: Column, source: Column) -> Column:
    """The identifiers of `text` that `source` lacks; finding them stays in built-ins, the check runs in batches."""

    @F.pandas_udf("array<string>")
    def missing(names: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for found, s in zip(names, sources, strict=True):
            known = read_source((s or "").lower()) if found is not None and len(found) else None
            out.append([n for n in found if not is_grounded(n, known)] if known else [])
        return pd.Series(out)

    return missing(identifiers(text), source)

"""Snippets of hits: the field with most matches, a window around its first match, and where matches lie in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Bytes of a snippet; it starts a quarter of them before the first match.
WIDTH = 200
FIELDS = ("text", "tag", "source")
#: White space that the ends of a snippet lose.
WHITE = "\t\n\v\f\r \x85\xa0                　"
WORD = re.compile(rb"[A-Za-z0-9]+")


def spans(raw: bytes, terms: set[bytes]) -> list[tuple[int, int]]:
    """Byte ranges of the words that are among the terms, whatever their case."""
    return [m.span() for m in WORD.finditer(raw) if m.group().lower() in terms]


def snippet(raw: bytes, found: list[tuple[int, int]], width: int = WIDTH) -> tuple[str, list[tuple[int, int]]]:
    """A window of whole characters around the first range, and the ranges within it as byte ranges of the snippet."""
    start = max(0, found[0][0] - width // 4)
    while start and raw[start] & 0xC0 == 0x80:
        start -= 1
    end = min(len(raw), start + width)
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    piece = raw[start:end].decode("utf-8", "replace")
    before, after = "…" if start else "", "…" if end < len(raw) else ""
    lead = len(piece.encode()) - len(piece.lstrip(WHITE).encode())
    shift = len(before.encode()) - lead - start
    return before + piece.strip(WHITE) + after, [(a + shift, b + shift) for a, b in found if a >= start and b <= end]


def best_field(text: str | None, tags: list[str | None] | None, source: str | None, terms: set[bytes], width: int = WIDTH) -> tuple[str, int, int, str, list[tuple[int, int]]] | None:
    """(field, tag, matches, snippet, ranges) of the field with most matches, of several the first; None without any."""
    fields = [(0, 0, text), *((1, i, t) for i, t in enumerate(tags or [])), (2, 0, source)]
    hits = [(-len(s), f, i, x.encode(), s) for f, i, x in fields if x and (s := spans(x.encode(), terms))]
    if not hits:
        return None
    n, f, i, raw, found = min(hits, key=lambda h: h[:3])
    return (FIELDS[f], i, -n, *snippet(raw, found, width))


def highlights(hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """`hits` (terms, text, tags, source, more) without these four, with field, tag, matches, snippet and highlights.

    `terms` is each hit's array of terms, in lower case. Highlights are (start, end) in bytes of the snippet, matches that
    the window cuts left out. A hit without a match in any field (or with null fields) has nulls. Meant for
    pages of results, it is a map over rows of any number.
    """
    given, made = ("terms", "text", "tags", "source"), ("field", "tag", "matches", "snippet", "highlights")
    more = [c for c in hits.columns if c not in (*given, *made)]
    source = hits.select(*more, *given)
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = source.select(*more).schema.add("field", "string").add("tag", "integer").add("matches", "integer").add("snippet", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True)
            best = [best_field(text, tags, src, {t.encode() for t in terms or [] if t}, width) or (None,) * 5 for terms, text, tags, src in rows]
            cols = [pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
            ranges = pa.array([None if b[4] is None else [{"start": s, "end": e} for s, e in b[4]] for b in best], pa.list_(pair))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *cols, ranges], [*more, *made])

    ranges_type = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    return source.mapInArrow(run, schema.add("highlights", ranges_type))

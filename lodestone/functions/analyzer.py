"""The full analyzer: words, identifiers with their parts, CJK bigrams, stems; in tasks, batch by batch."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, wraps
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.functions.stemmer import porter2

JOINERS = "_-./:@#"
TERM_BYTES, PREFIX_BYTES, HASH_DIGITS = 64, 48, 12
MOST_PARTS, OPAQUE_LENGTH = 64, 16
MOST_GROUPS, MOST_TERMS, MOST_QUERY_PARTS = 32, 128, 16

#: Features of a kind that a text offers at most, bytes of the longest identifier, and characters of the text's opening.
MOST_FEATURES, IDENTIFIER_BYTES, OPENING = 8, 64, 100

#: Documents with their words that a task holds at once.
HELD = 64
#: Rows that a task holds at once; stretches of text that it remembers, and the longest of these.
SLICE, REMEMBERED, LONGEST = 1 << 15, 1 << 16, 64

_split = regex.compile(r"(?V1w)\b").split
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_WORD = regex.compile(r"[\p{L}\p{N}]")


class Part(NamedTuple):
    term: str
    stem: str | None


class Token(NamedTuple):
    kind: str
    exact: str
    stem: str | None
    parts: tuple[Part, ...]
    raw: str = ""  # as it stands in the text


def normalize(s: str) -> str:
    """Case and accents folded, compatibility forms resolved, typographic apostrophes straightened."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).casefold())
    s = unicodedata.normalize("NFC", "".join(c for c in s if unicodedata.category(c) != "Mn"))
    return s.replace("‘", "'").replace("’", "'").replace("ʼ", "'")


def bound(term: str) -> str:
    raw = term.encode()
    if len(raw) <= TERM_BYTES:
        return term
    return raw[:PREFIX_BYTES].decode(errors="ignore") + "#" + hashlib.sha256(raw).hexdigest()[:HASH_DIGITS]


_STEMMABLE = re.compile(r"[a-z']*[a-z][a-z']*")


def stem(term: str) -> str | None:
    return bound("~" + porter2(term)) if _STEMMABLE.fullmatch(term) else None


_TID = re.compile(r"[2-7a-j][2-7a-z]{12}")
_ALNUM = re.compile(r"[0-9A-Za-z]+")
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")


def is_opaque(s: str) -> bool:
    if _TID.fullmatch(s) and not s.isalpha():
        return True
    if len(s) < OPAQUE_LENGTH or not _ALNUM.fullmatch(s):
        return False
    return s.isdigit() or len(_RUNS.findall(s)) > 3


@lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """Upper or title case, number (any of N*), other letter, or none of these."""
    kind = unicodedata.category(c)
    return "U" if kind in ("Lu", "Lt") else "D" if kind[0] == "N" else "L" if kind[0] == "L" else "O"


def _sub_words(s: str) -> list[str]:
    """Pieces between case changes, after acronyms (but for a plural s), and between letters and digits."""
    kinds = "".join(map(_class, s))
    cuts = [0]
    for i in range(1, len(s)):
        a, b = kinds[i - 1], kinds[i]
        if a + b in ("LU", "LD", "UD", "DL", "DU"):
            cuts.append(i)
        elif a + b == "UU" and kinds[i + 1 : i + 2] == "L" and not (i + 2 == len(s) and s[-1] == "s"):
            cuts.append(i)
    return [s[i:j] for i, j in zip(cuts, [*cuts[1:], len(s)], strict=True)]


@lru_cache(maxsize=1 << 14)
def word_token(raw: str) -> Token | None:
    """The token of a word or compound, joiners trimmed."""
    raw = raw.strip(JOINERS)
    exact = bound(normalize(raw))
    if not exact:
        return None
    if is_opaque(raw):
        return Token("opaque", exact, None, (), raw)
    components = [c for c in re.split(f"[{re.escape(JOINERS)}]+", raw) if c]
    parts: list[Part] = []
    spans: list[str] = []
    for c in components:
        for piece in [c] if is_opaque(c) else _sub_words(c):
            if len(piece) >= 2 and len(parts) < MOST_PARTS and (term := bound(normalize(piece))):
                parts.append(Part(term, None if piece is c and is_opaque(c) else stem(term)))
                spans.append(piece)
    if len(components) == 1 and (not parts or spans == [raw]):
        return Token("word", exact, stem(exact), (), raw)
    return Token("compound", exact, None, tuple(parts), raw)


def tokenize(text: str) -> list[Token]:
    """No token crosses white space, so each stretch between is analyzed once and remembered."""
    return [t for chunk in _chunks(text) for t in _chunk_tokens(chunk)]


def _chunks(text: str) -> list[str]:
    """The stretches between white space; marks right after a space belong to the space."""
    out = text.split()
    for i, c in enumerate(out):
        if c[0] > "\x7f" and (i or text[0] != c[0]):
            n = next((k for k, x in enumerate(c) if unicodedata.category(x) not in ("Mn", "Mc", "Me", "Cf")), len(c))
            out[i] = c[n:]
    return out


def _remembered(f: Callable) -> Callable:
    """`f` of a stretch of text, remembered unless the stretch is long."""
    kept = lru_cache(maxsize=REMEMBERED)(f)

    @wraps(f)  # tasks find it by its name
    def run(text: str):
        return kept(text) if len(text) <= LONGEST else f(text)

    return run


@_remembered
def _chunk_tokens(text: str) -> tuple[Token, ...]:
    """The tokens of a stretch; most are one plain word, perhaps with punctuation after it, which needs no rules."""
    plain = text.rstrip(".,;:!?)")
    if plain.isalpha() and (plain[1:].islower() or len(plain) == 1) and max(plain) < "\u0590":
        exact = bound(normalize(plain))
        return (Token("word", exact, stem(exact), (), plain),) if exact else ()
    return tuple(_general_tokens(text))


def _general_tokens(text: str) -> list[Token]:
    out: list[Token | None] = []
    word = cjk = ""
    pending = ""  # joiners that follow a word, in case another word comes

    def flush() -> None:
        nonlocal word, cjk, pending
        if word:
            out.append(word_token(word))
        if cjk:
            for i in range(max(1, len(cjk) - 1)):
                out.append(Token("cjk", bound(normalize(cjk[i : i + 2])), None, (), cjk[i : i + 2]))
        word = cjk = pending = ""

    for piece in _split(text):
        if not piece:
            continue
        if _CJK.match(piece):
            if word:
                flush()
            cjk += piece
            continue
        if cjk:
            flush()
        if all(c in JOINERS for c in piece):
            if word:
                pending += piece
        elif _WORD.search(piece):
            word, pending = (word + pending + piece, "") if word and pending else (flush() or piece, "") if word else (piece, "")
        else:
            flush()
    flush()
    return [t for t in out if t is not None]


@_remembered
def _chunk_terms(chunk: str) -> tuple[int, tuple[str, ...]]:
    """Number of tokens, and the terms that each of them adds one to."""
    tokens = _chunk_tokens(chunk)
    return len(tokens), tuple(x for t in tokens for x in terms_of(t))


def terms_of(t: Token) -> set[str]:
    return {x for x in (t.exact, t.stem, *(y for p in t.parts for y in p)) if x}


def count_terms(text: str, tags: list[str], source: str) -> tuple[int, Counter]:
    """Length in tokens, and term frequencies: each token adds one to each distinct term that it emits."""
    length, tf = 0, Counter()
    for chunk, times in _counted_chunks(text, tags, source):
        n, terms = _chunk_terms(chunk)
        length += n * times
        for x in terms:
            tf[x] += times
    return length, tf


def _counted_chunks(text: str | None, tags: Sequence[str], source: str | None) -> Iterable[tuple[str, int]]:
    return Counter(c for field in (text, *tags, source) for c in _chunks(field or "")).items()


class Group(NamedTuple):
    exact: str
    stem: str | None
    parts: tuple[Part, ...]


def parse_query(text: str) -> list[Group]:
    """Groups of alternatives. Repeated tokens count once; the query ends at the first token over the limits."""
    groups: list[Group] = []
    terms: set[str] = set()
    for t in tokenize(text):
        if any(g.exact == t.exact for g in groups):
            continue
        once: dict[str, Part] = {}
        for p in t.parts:
            once.setdefault(p.term, p)
        g = Group(t.exact, t.stem, tuple(once.values())[:MOST_QUERY_PARTS])
        new = terms | {x for x in (g.exact, g.stem, *(y for p in g.parts for y in p)) if x}
        if len(groups) == MOST_GROUPS or len(new) > MOST_TERMS:
            break
        groups.append(g)
        terms = new
    return groups


def _sliced(rows: Callable[..., Iterable[tuple]], schema: pa.Schema, size: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`rows` of each input row, `size` or SLICE at a time: what a task holds doesn't grow with a batch's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in batches for i in range(b.num_rows) for r in rows(*(c[i].as_py() for c in b.columns)))
        while part := list(islice(found, size or SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    return run


_IDENTIFIER = re.compile(r"[_./:@#0-9]|(?s:.)[A-Z]")


def features(memories: DataFrame) -> DataFrame:
    """(id, opening, identifiers, compounds, tag_source, words, others): what each text offers, verbatim, in its order.

    Identifiers are opaque tokens and compounds that look like one; `compounds` are those of two parts or more; `tag_source`
    holds words of tags and source that the text lacks; MOST_FEATURES of each. `words` may be rare, which takes the whole table: one
    string of words with spaces between, each with a tab and its exact term behind it where that differs. `others` are the further terms that count as one of such a word, so that words and others together
    hold each of the memory's terms of this form once.
    """

    def rows(i: int | None, text: str | None, tags: list[str] | None, source: str | None) -> Iterator[tuple]:
        identifiers, compounds, tag_source, words = {}, {}, {}, {}
        in_text, terms = set(), set()

        def add(found: dict, raw: str) -> None:
            if len(found) < MOST_FEATURES:
                found[raw] = None

        def count(t: Token) -> None:
            if t.stem is not None or (t.kind == "compound" and _STEMMABLE.fullmatch(t.exact)):
                terms.add(t.exact)
            terms.update(p.term for p in t.parts if p.stem is not None)

        for t in (t for c in dict.fromkeys(_chunks(text or "")) for t in _chunk_tokens(c)):
            in_text.add(t.exact)
            count(t)
            if t.kind == "opaque":
                add(identifiers, t.raw)
            elif t.kind == "compound" and len(t.raw.encode()) <= IDENTIFIER_BYTES and "://" not in t.raw and _IDENTIFIER.search(t.raw):
                add(identifiers, t.raw)
                if len(t.parts) >= 2:
                    add(compounds, t.raw)
            elif t.kind == "word" and t.stem is not None and len(t.raw.encode()) >= 4:
                words[t.raw] = t.exact
        for t in (t for s in (*(tags or []), source) for c in _chunks(s or "") for t in _chunk_tokens(c)):
            count(t)
            if t.kind == "word" and len(t.exact.encode()) >= 3 and t.exact not in in_text:
                add(tag_source, t.raw)
        pairs = " ".join(r if x == r else f"{r}\t{x}" for r, x in words.items())
        return iter([(i, (text or "")[:OPENING], list(identifiers), list(compounds), list(tag_source), pairs, sorted(terms.difference(words.values())))])

    strings = pa.list_(pa.string())
    schema = pa.schema([("id", pa.int64()), ("opening", pa.string()), *((c, strings) for c in ("identifiers", "compounds", "tag_source")), ("words", pa.string()), ("others", strings)])
    names = "id long, opening string, identifiers array<string>, compounds array<string>, tag_source array<string>, words string, others array<string>"
    return memories.selectExpr("CAST(id AS long) AS id", "text", "tags", "source").mapInArrow(_sliced(rows, schema, HELD), names)


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n, stems, parts): each document's tokens of each kind, counted inside the task."""

    def rows(i: int | None, text: str | None) -> Iterator[tuple]:
        n, stems, parts = Counter(), Counter(), Counter()
        for c, times in Counter(_chunks(text or "")).items():
            for t in _chunk_tokens(c):
                n[t.kind] += times
                stems[t.kind] += times * (t.stem is not None)
                parts[t.kind] += times * len(t.parts)
        return ((i, k, n[k], stems[k], parts[k]) for k in n)

    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), *((c, pa.int64()) for c in ("n", "stems", "parts"))])
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(_sliced(rows, schema), "doc_id long, kind string, n long, stems long, parts long")


def postings(memories: DataFrame) -> DataFrame:
    """(id, dl, term, tf) under the full analyzer: counted inside the task, so no shuffle is needed."""

    def rows(i: int | None, text: str | None, tags: list[str] | None, source: str | None) -> Iterator[tuple]:
        n, tf = count_terms(text, tags or [], source)
        return ((i, n, term, c) for term, c in tf.items())

    schema = pa.schema([("id", pa.int64()), ("dl", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])
    return memories.select("id", "text", "tags", "source").mapInArrow(_sliced(rows, schema), "id long, dl long, term string, tf long")


def counts_of(memories: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, dl, tf): each document's length and its counts of `terms`, in their order; documents without a token are left out."""
    place = {t: i for i, t in enumerate(terms)}

    def rows(i: int | None, text: str | None, tags: list[str] | None, source: str | None) -> Iterator[tuple]:
        length, tf = 0, [0] * len(place)
        for chunk, times in _counted_chunks(text, tags or [], source):
            n, own = _chunk_terms(chunk)
            length += n * times
            for x in own:
                if x in place:
                    tf[place[x]] += times
        return iter([(i, length, tf)] if length else [])

    schema = pa.schema([("id", pa.int64()), ("dl", pa.int64()), ("tf", pa.list_(pa.int64()))])
    return memories.select("id", "text", "tags", "source").mapInArrow(_sliced(rows, schema), "id long, dl long, tf array<long>")


def register_tokenize(spark) -> None:
    """SQL's tokenize(text): a table function with a row (kind, exact, stem) for each token."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="kind string, exact string, stem string")
    class Tokenize:
        def eval(self, text: str):
            for t in tokenize(text or ""):
                yield t.kind, t.exact, t.stem

    spark.udtf.register("tokenize", Tokenize)

"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Each candidate merge (document, place, sizes of both sides) that comes up in the agenda is skipped for good if its hash
under the seed falls below the dropout rate; the others are merged in agenda order, lowest rank first, left first
(agenda.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.agenda import drawing, work_agendas
from lodestone.llm.common import codepoints, mix, ranges, runs

#: Stands for a U+2581 of the text itself; a surrogate, so no text holds it.
LITERAL = 0xD800
#: Characters of pre-tokens that are merged for themselves at once.
AT_ONCE = 1 << 19


def encode(docs: DataFrame, vocabulary_path: str, seed: int = 0, dropout: float = 0.1, text: str = "text") -> DataFrame:
    """`docs` without its text, with `ids`: the token ids as little-endian 32-bit integers in one binary.

    A document's key is its text and, if there is one, its doc_id. The same seed gives the same ids, wherever
    and however often a task runs. dropout 0 gives the library's own segmentation, but for a literal U+2581, which
    is spelled as bytes so that it reads back. Null or empty texts give an empty binary; repeated rows stay; a column
    named `ids` is replaced; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (text, "ids")]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        v = bpe.vocabulary(vocabulary_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names = batch.column("doc_id").to_pylist() if "doc_id" in kept else [""] * len(texts)
            keys = [xxhash.xxh64_intdigest(f"{n}\0{t}".encode(), 42) for n, t in zip(names, texts, strict=True)]
            for a, b in runs(texts):
                ids, at = encode_texts(v, texts[a:b], seed, dropout, keys[a:b])
                raw, at = ids.astype("<i4").tobytes(), at * 4
                part = batch.slice(a, b - a)
                packed = pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], [*part.schema.names[:-1], "ids"])

    return source.mapInArrow(run, schema)


def encode_texts(v: bpe.PieceVocabulary, texts: list[str], seed: int, p: float, doc_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in one array, and where each text's ids start.

    Each place of each document draws for itself, by a hash of the seed, the document's key (64 bits, one for
    each text) and the place. A pre-token's agenda is worked once without dropout; the places whose draws skip
    nothing of what it pops share its outcome, every other place has an agenda of its own.
    """
    codes, bounds = codepoints([" " + t if t else "" for t in texts])
    space = ord(bpe.SPACE)
    codes = np.where(codes == space, LITERAL, np.where(codes == 32, space, codes)).astype(np.uint32)
    starts = bpe.cut_places(v, codes, bounds)
    of = np.searchsorted(bounds, starts, side="right") - 1
    place = (starts - bounds[of]).astype(np.uint64)
    key = mix(np.full(1, seed & 0xFFFFFFFFFFFFFFFF, np.uint64))
    keys = mix(place + mix(np.array(doc_keys, np.uint64)[of] ^ key))
    own, lengths, _, which = bpe.distinct(codes, starts)
    (sym, at, _, seq), popped = work_agendas(v, own, lengths)
    if p > 0:
        alone = drawing(popped, len(lengths), which, keys, p)
        size = np.diff(np.r_[starts, len(codes)])[alone]
        parts = [(own, lengths, sym, at, seq)]
        n = len(lengths)
        which[alone] = n + np.arange(len(alone))
        ends = np.cumsum(size)
        lo = 0
        while lo < len(alone):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            some = codes[ranges(starts[alone[lo:hi]], size[lo:hi])]
            (s, a, _, q), _ = work_agendas(v, some, size[lo:hi], keys[alone[lo:hi]], p)
            parts.append((some, size[lo:hi], s, a, q + n + lo))
            lo = hi
        own, lengths, sym, at, seq = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin = np.cumsum(lengths) - lengths
    strange = (sym < 0) | (sym >= v.size)
    reps = np.ones(len(sym), np.int64)
    chars = own[begin[seq] + at]
    spelled = [bytes(bpe.SPACE if c == LITERAL else chr(c), "utf-8") for c in chars[strange].tolist()]
    reps[strange] = [len(b) for b in spelled]
    ids = np.repeat(sym.astype(np.int32), reps)
    ids[np.repeat(strange, reps)] = v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)] if spelled else ids[:0]
    per = np.bincount(seq, weights=reps, minlength=len(lengths)).astype(np.int64)
    first = np.cumsum(per) - per
    out = ids[ranges(first[which], per[which])]
    total = np.r_[0, np.cumsum(per[which])]
    return out, total[np.searchsorted(starts, bounds)]


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """The rows with `text` in the place of `ids`; empty or null ids give an empty text."""
    kept = [c for c in encoded.columns if c not in ("ids", "text")]
    source = encoded.select(*kept, "ids")
    schema = source.drop("ids").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(vocabulary_path)
        for batch in batches:
            held = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in runs(held):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(decode_ids(v, held[a:b]), pa.string())], [*part.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema)


def decode_ids(v: bpe.PieceVocabulary, held: list[bytes]) -> list[str]:
    """The texts again: pieces and bytes side by side, spaces restored, the leading one dropped."""
    ids = np.frombuffer(b"".join(held), "<i4")
    raw, start, size = _raw_pieces(v)
    spelled = raw[ranges(start[ids], size[ids])].tobytes()
    ends = np.r_[0, np.cumsum(size[ids])][np.cumsum([0, *(len(x) // 4 for x in held)])].tolist()
    texts = (spelled[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True))
    return [t.removeprefix(" ") for t in texts]


def _raw_pieces(v: bpe.PieceVocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces in one array, and where each one's begin and how many they are."""
    if not hasattr(v, "raw"):
        pieces = [p.replace(bpe.SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids.tolist()):
            if i >= 0:
                pieces[i] = bytes([b])
        size = np.array([len(p) for p in pieces])
        v.raw = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size
    return v.raw

"""Best-fit packing planned over the histogram of lengths.

Documents are never sorted or placed one by one. The counts of the lengths (at most `capacity` of them) go to
the driver, which runs best-fit decreasing over counts and gets a plan of slots: so many pieces of one length,
from such a rank on, go to such sequences. Pieces then take their slots by a join on their rank within the
length. A rank is found without gathering a length in one task: pieces of a length are dealt to about as
many salts as the square root of their count, numbered within the salt, and moved by the counts before it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import codepoints, cut, ranges, runs, segment_hashes, sums_between

#: What the tokenizer's pattern takes as white space, which parts words and gives no token.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words whose ids one Python worker remembers.
REMEMBERED = 1_500_000


class WordTokenizer:
    """Ids of texts from a tokenizer that drops white space, with each distinct word tokenized once per worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.white = np.zeros(0x110000, bool)
        self.white[WHITE] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, *(np.array(x, np.uint32) for x in found)]) if found else self.ids
        where = np.searchsorted(self.known, hashes)
        self.known, self.at, self.count = (np.insert(x, where, y) for x, y in ((self.known, hashes), (self.at, at), (self.count, count)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids start (one more entry at the end)."""
        codes, bounds = codepoints(texts)
        solid = ~self.white[codes]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = bounds[:-1][bounds[:-1] < len(codes)]
        first[inner] |= solid[inner]
        starts = np.flatnonzero(first)
        squeezed = np.r_[0, np.cumsum(solid)]
        text_codes, word_at = codes[solid], squeezed[starts]
        lengths = np.diff(np.r_[word_at, len(text_codes)])
        hashes = segment_hashes(text_codes, word_at, lengths)
        own, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != own) if len(self.known) else np.arange(len(own))
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(own))
        if len(new):
            chars = text_codes[ranges(word_at[one[new]], lengths[one[new]])].tobytes().decode("utf-32-le")
            ends = np.cumsum(lengths[one[new]]).tolist()
            self.learn(own[new], [chars[i:j] for i, j in zip([0, *ends], ends, strict=False)])
        at = np.searchsorted(self.known, own)
        begin, count = self.at[at][which], self.count[at][which]
        return self.ids[ranges(begin, count)], np.r_[0, np.cumsum(sums_between(count, np.searchsorted(starts, bounds)))]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each document's ids and an end id, cut at every `capacity`.

    ids is a binary of little-endian unsigned 32-bit integers. Null texts count as empty and give one piece
    that holds the end id; repeated rows and null ids each give their own pieces. No shuffle.
    """
    source = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    names = ["doc_id", "piece", "start", "length", "ids"]
    schema = source.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs(texts):
                ids, at = tokenizer.encode(texts[a:b])
                n = np.diff(at) + 1
                full = np.insert(ids, at[1:], end_id).astype("<u4")
                begin = at[:-1] + np.arange(b - a)
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(b - a), pieces)
                piece = ranges(np.zeros(b - a, np.int64), pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[of] - start)
                raw, lo = full.tobytes(), (begin[of] + start) * 4
                packed = [raw[i:j] for i, j in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(packed, pa.binary())], names)

    return source.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Sequences with equal room are kept as ranges, so the work and the plan are bounded by the capacity, not by
    the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, opened = [], 0

    def put(left: int, start: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((start, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            size = rooms[k]
            start, n = room[size].pop()
            if not room[size]:
                del room[size], rooms[k]
            each = size // length
            whole = min(n, left // each)
            if whole:
                slots.append((length, rank, whole * each, start, each, capacity - size))
                put(size - each * length, start, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and 0 < left < each:
                slots.append((length, rank, left, start + whole, left, capacity - size))
                put(size - left * length, start + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(size, start + whole, n - whole)
    return slots


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` with sequence_id and offset; their lengths are 1 to `capacity`.

    Equal lengths may swap places, so ties have no order to keep. Any columns pass through (those named
    sequence_id or offset are replaced); an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.drop("sequence_id", "offset"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    salts = spark.createDataFrame([(k, max(1, round(n**0.5))) for k, n in counts.items()], "__length long, __salts long")
    slots = spark.createDataFrame(plan(counts, capacity), "__length long, __first long, __n long, __seq long, __each long, __offset long")
    # The checkpoint fixes partitions and order, so this id is the same whenever a task runs again.
    dealt = pieces.withColumn("__uid", F.monotonically_increasing_id()).join(F.broadcast(salts), F.col("length") == F.col("__length")).drop("__length")
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.col("__salts"))).drop("__salts")
    before = dealt.groupBy("length", "__salt").agg(F.count("*").alias("__count"))
    before = before.select("length", "__salt", (F.sum("__count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__count")).alias("__before"))
    ranked = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__uid")))
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__rn") - 1)
    into = F.col("__rank") - F.col("__first")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("__length")) & (into >= 0) & (into < F.col("__n")))
    return placed.select(
        *pieces.columns,
        (F.col("__seq") + F.floor(into / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + into % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )

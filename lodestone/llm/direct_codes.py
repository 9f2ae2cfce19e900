"""Token ids as files of directly addressable codes.

An id is split into chunks of eight bits, the low one first. Level 0 holds the first chunk of every id, level 1 the
second chunk of those ids that have one, and so on. A bitmap beside each level but the last says which ids go on; a
directory holds the number of set bits before every 512th. The place of an id's next chunk is the rank of
its bit, so any id is read from a few bytes of each level without decoding its neighbours.

A file, all numbers little-endian:

    b"DACIDS01", crc32 of all that follows up to the end (u32), levels (u32),
    part, place in the part, documents, ids (u64 each),
    doc_id (i64 each), null doc_id (u8 each, padded), ids up to each document's end (u64 each),
    then for each level: chunks (u64 their number, u8 each, padded), and for all but the last
    the bitmap (u64 words, whole blocks of 512 bits) and the directory (u32 a block, padded).

Padding is to eight bytes. Spark's text writer puts the files into place, on any file system that it reaches and
under its commit protocol, and ends each with a line feed, which readers ignore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, runs
from lodestone.llm.packing import word_tokenizer
from lodestone.operators.running import running

MAGIC = b"DACIDS01"
HEAD = 16 + 4 * 8
BLOCK = 512
#: Ids after which a file is closed; a longer document still lies in one file.
FILE_IDS = 1 << 22


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def encode_ids(ids: np.ndarray) -> tuple[int, bytes]:
    """Number of levels, and the levels' bytes."""
    out, rest, levels = [], ids.astype("<u4"), 0
    while True:
        levels += 1
        out += [np.array([len(rest)], "<u8").tobytes(), _padded((rest & 0xFF).astype("u1"))]
        rest = rest >> 8
        more = rest > 0
        if not more.any():
            return levels, b"".join(out)
        bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
        out += [bits.tobytes(), _padded((np.cumsum(ones) - ones).astype("<u4"))]
        rest = rest[more]


def encode_file(part: int, place: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; `counts` has each one's number of ids."""
    levels, body = encode_ids(ids)
    head = np.array([part, place, len(doc_ids), len(ids)], "<u8").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + _padded(np.array([d is None for d in doc_ids], "u1"))
    rest = np.array([levels], "<u4").tobytes() + head + names + np.cumsum(counts).astype("<u8").tobytes() + body
    return MAGIC + np.array([zlib.crc32(rest)], "<u4").tobytes() + rest


class Codes:
    """A file's bytes, opened: documents, and ids by their places."""

    def __init__(self, raw: bytes, check: bool = False):
        if raw[:8] != MAGIC or len(raw) < HEAD:
            raise ValueError("not a file of token ids")
        crc, levels = np.frombuffer(raw, "<u4", 2, 8).tolist()
        self.part, self.place, docs, self.n = np.frombuffer(raw, "<u8", 4, 16).tolist()
        self._at, self._raw = HEAD, raw
        try:
            self.doc_ids, self.null = self._take("<i8", docs), self._take("u1", docs).astype(bool)
            self.ends = self._take("<u8", docs).astype(np.int64)
            self.chunks, self.words, self.directory = [], [], []
            for level in range(levels):
                n = int(self._take("<u8", 1)[0])
                self.chunks.append(self._take("u1", n))
                if level + 1 < levels:
                    blocks = -(-n // BLOCK)
                    self.words.append(self._take("<u8", blocks * (BLOCK // 64)))
                    self.directory.append(self._take("<u4", blocks))
        except ValueError as e:
            raise ValueError("a file of token ids is cut short") from e
        if check and zlib.crc32(memoryview(raw)[12 : self._at]) != crc:
            raise ValueError("a file of token ids is damaged")

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._raw, kind, n, self._at)
        self._at += -(-out.nbytes // 8) * 8
        return out

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's entry, whole words of the block, then part of a word."""
        words, word = self.words[level], at >> 6
        block = np.minimum(at // BLOCK, len(self.directory[level]) - 1)
        out = self.directory[level][block].astype(np.int64)
        for k in range(BLOCK // 64):
            w = block * (BLOCK // 64) + k
            out += np.where(w < word, np.bitwise_count(words[w]), 0)
        inside = at & 63
        part = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << inside.astype(np.uint64)) - np.uint64(1))
        return out + np.where(inside > 0, np.bitwise_count(part), 0)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places of the file, in any order."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("no such place")
        out, own = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, chunks in enumerate(self.chunks):
            out[own] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.chunks) or not len(own):
                break
            on = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            own, at = own[on], self._rank(level, at[on])
        return out

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids from place `lo` up to `hi`: two ranks a level, then one run of chunks."""
        out, own = np.zeros(hi - lo, np.uint32), np.arange(hi - lo)
        for level, chunks in enumerate(self.chunks):
            out[own] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.chunks) or lo == hi:
                break
            first = lo >> 6
            bits = np.unpackbits(self.words[level][first : -(-hi // 64)].view("u1"), bitorder="little")
            own = own[bits[lo - first * 64 : hi - first * 64].astype(bool)]
            lo, hi = self._rank(level, np.array([lo, hi])).tolist()
        return out

    def bounds(self) -> np.ndarray:
        """Where each document's ids start, and one more entry at the end."""
        return np.r_[0, self.ends]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write each document's ids and an end id to files under `folder`, by ascending doc_id, and an index of the files.

    Rows go to tasks by ranges of doc_id; a task closes a file after `file_ids` ids. Null texts count as empty.
    A null doc_id comes before all others; rows that share one follow each other by a hash of their texts, then
    their texts. The index (part, place, path, docs, ids, start) tells how many ids all files before hold; it is
    made from the written files, whose checksums are verified with it. An empty table gives an empty index.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("t"))
    ordered = source.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, place = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            raw = encode_file(part, place, names, np.concatenate(counts), np.concatenate(held))
            return pa.RecordBatch.from_pydict({"file": pa.array([raw], pa.binary())})

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in runs(texts, min(1 << 21, file_ids)):
                ids, at = tokenizer.encode(texts[a:b])
                names += ids_of[a:b]
                counts.append(np.diff(at) + 1)
                held.append(np.insert(ids, at[1:], end_id))
                size += len(held[-1])
                if size >= file_ids:
                    yield closed()
                    names, counts, held, size, place = [], [], [], 0, place + 1
        if names:
            yield closed()

    files = ordered.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{folder}/ids")
    _index(docs.sparkSession, folder).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/ids").select("path", "content")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(body := raw.as_py()):
                    c = Codes(body, check=True)
                    yield pa.RecordBatch.from_pydict({"part": [c.part], "place": [c.place], "path": [path], "docs": [len(c.doc_ids)], "ids": [c.n]})

    found = cut(_files(spark, folder).mapInArrow(heads, "part long, place long, path string, docs long, ids long"))
    sums = running(found.withColumn("all", F.lit(0)), ["all"], ["part", "place"], F.floor(F.col("part") / 1024), {"so_far": "ids"})
    return sums.select("part", "place", "path", "docs", "ids", (F.col("so_far") - F.col("ids")).alias("start"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) read back from the files: the ids before the document, its own, as a binary of
    little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                if not len(body := raw.as_py()):
                    continue
                c, lo = Codes(body), 0
                at = c.bounds()
                while lo < len(c.doc_ids):
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1)
                    ids = c.slice(int(at[lo]), int(at[hi])).astype("<u4").tobytes()
                    ends = ((at[lo : hi + 1] - at[lo]) * 4).tolist()
                    one = np.full(hi - lo, c.part), np.full(hi - lo, c.place)
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, one), pa.array(c.doc_ids[lo:hi], mask=c.null[lo:hi]), pa.array(at[lo:hi]), pa.array(np.diff(at[lo : hi + 1])), pa.array([ids[i:j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())],
                        ["part", "place", "doc_id", "at", "n_tokens", "ids"],
                    )
                    lo = hi

    rows = _files(spark, folder).select("content").mapInArrow(run, "part long, place long, doc_id long, at long, n_tokens long, ids binary")
    index = spark.read.parquet(f"{folder}/index").select("part", "place", "start")
    return rows.join(index, ["part", "place"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame, places: str = "position", span: int = FILE_IDS) -> DataFrame:
    """(position, id) for every distinct position of `wanted` within the whole sequence; others give no row.

    Files and positions meet by spans of positions, then each file that holds any is opened once, for all of them:
    at most as many as it has ids.
    """
    index = spark.read.parquet(f"{folder}/index").select("path", "start", (F.col("start") + F.col("ids")).alias("end")).where("end > start")
    covered = F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span)))
    by_span = index.withColumn("__span", covered)
    asked = wanted.select(F.col(places).cast("long").alias("position")).where("position >= 0").distinct().withColumn("__span", F.floor(F.col("position") / span))
    met = asked.join(by_span, "__span").where("position >= start AND position < end")
    each = met.groupBy("path", "start").agg(F.array_sort(F.collect_list(F.col("position") - F.col("start"))).alias("places"))
    opened = _files(spark, folder).join(each, "path").select("content", "start", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start, own in zip(*batch.columns, strict=True):
                at = own.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"position": pa.array(at + start.as_py()), "id": pa.array(Codes(raw.as_py()).get(at).astype(np.int64))})

    return opened.mapInArrow(run, "position long, id long")

"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, pairs of words and character n-grams; a linear layer and a
softmax over two classes follow. Training is plain stochastic gradient descent in numpy over a bounded sample
of labelled rows. As both layers are linear, the trained model folds into one number for each bucket (the
vector's share of the log odds), so scoring a text is a gather and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import codepoints, mix, runs, segment_hashes

BITS = 18
BUCKETS = 1 << BITS
NGRAMS = (3, 4)
DIM = 16
EPOCHS = 6
RATE = 0.5
#: Documents that training reads at most, however many are labelled: those with the lowest hash of their id; and
#: distinct features of all of them together (8 bytes each), so that long texts can't fill the driver.
MAX_TRAIN, MAX_FEATURES = 3000, 12_000_000
WHITE = np.array([*range(9, 14), 32, 0x85, 0xA0], np.uint32)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: The bucket of a word that follows itself.
REPEATED = (mix(_STEPS[:1]) >> np.uint64(64 - BITS)).astype(np.int32)[0]


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (buckets, texts they belong to) for words, each n of the n-grams, and pairs of neighbouring words.

    N-grams hold white space at their ends only, as word boundaries. Pairs of words have no order: their hash is
    that of both words' hashes combined by XOR. A word that follows itself is a feature of its own, REPEATED,
    whichever word it is.
    """
    codes, bounds = codepoints(texts)
    if not len(codes):
        return []
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    white = np.isin(codes, WHITE)
    wide = np.where(white, np.uint64(32), codes.astype(np.uint64))
    out = []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        ok = doc[:m] == doc[n - 1 :]
        for i in range(n):
            h += wide[i : i + m] * _STEPS[i]
            if 0 < i < n - 1:
                ok &= ~white[i : i + m]
        out.append(((mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int32), doc[:m][ok]))
    first = np.ones(len(codes), bool)
    first[1:] = (white[1:] != white[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    hashes = segment_hashes(codes, starts, np.diff(np.r_[starts, len(codes)]))
    solid = ~white[starts]
    words, owner = hashes[solid], doc[starts[solid]]
    out.append(((words >> np.uint64(64 - BITS)).astype(np.int32), owner))
    same = owner[1:] == owner[:-1]
    both = (words[1:] ^ words[:-1])[same]
    pairs = (mix(both + _STEPS[0]) >> np.uint64(64 - BITS)).astype(np.int32)
    out.append((np.where(both == 0, REPEATED, pairs), owner[1:][same]))
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their counts."""
    return np.unique(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in features([text]))]), return_counts=True)


@dataclass
class Model:
    """log odds of label 1 = bias + mean over features of weight[bucket]."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in runs(texts, 1 << 20):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for buckets, owner in features(texts[a:b]):
                total += np.bincount(owner, weights=self.weight[buckets], minlength=b - a)
                n += np.bincount(owner, minlength=b - a)
            out[a:b] = self.bias + total / np.maximum(1, n)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """Train on (buckets, counts) of each document. Without both classes the prior is all that is learnt."""
    ones = int(labels.sum())
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1))) if len(labels) else 0.0
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    total, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - step / total)
            step += 1
            buckets, counts = bags[i]
            share = counts.astype(np.float32) / max(1, int(counts.sum()))
            hidden = share @ vectors[buckets]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p).astype(np.float32)
            bias -= rate * 0.1 * p
            # the mean's gradient spread over a document's features, scaled so that long texts learn as fast
            vectors[buckets] -= (rate * np.sqrt(len(buckets)) * share[:, None] * back).astype(np.float32)
    odds = out[:, 1] - out[:, 0]
    return Model((vectors @ odds).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most `max_rows` labelled documents; executors turn texts into counts of buckets.

    Rows with a null label or id are left out; of repeated ids the lowest label counts; repeated rows of
    `docs` all count. In the order of their ids' hashes, documents are taken as long as they have `max_features`
    distinct features or fewer together, which bounds what comes to the driver.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(chosen), "doc_id")
    source = source.select("doc_id", "__label", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(2).to_pylist()):
                own, n = bag(t)
                row = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([own.astype("<i4").tobytes()]), pa.array([n.astype("<i4").tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["doc_id", "label", "buckets", "counts"])

    counted = source.mapInArrow(count, source.select("doc_id").schema.add("label", "integer").add("buckets", "binary").add("counts", "binary"))
    order = (F.xxhash64("doc_id"), "doc_id", "buckets", "counts")
    first = counted.orderBy(*order).limit(max_rows)  # a bounded sample, in one partition
    so_far = F.sum(F.octet_length("buckets") / 4).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = first.withColumn("so_far", so_far).where(F.col("so_far") <= max_features).select("label", "buckets", "counts").toArrow()
    # views of Arrow's own buffers, so that the sample is held once
    bags = [tuple(np.frombuffer(x.as_buffer(), "<i4") for x in pair) for pair in zip(rows.column("buckets"), rows.column("counts"), strict=True)]
    return fit(bags, rows.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= 0.5, else 0).

    A null or empty text gets the score of the bias alone. A map without a shuffle; every row stays; columns
    named score or predicted are replaced, and the text goes unless keep_text. The model that each task gets
    has a fixed size (one number a bucket).
    """
    source = docs.select(*[c for c in docs.columns if c not in ("score", "predicted", text)], text)
    schema = (source if keep_text else source.drop(text)).withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.scores(texts))], schema.names)

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1

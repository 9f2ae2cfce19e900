"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two words are one inserted, deleted or replaced code point apart if and only if their common prefix and their common
suffix together reach the longer length minus one. Tiles test this densely: the words of a tile are rows of a matrix
of code points, padded, and prefix and suffix lengths of all its pairs grow column by column.

Only words of one group meet. A group is (m, a, b): words of m code points, and of m + 1, that share their first `a` and
their last `b`. The pair of a word of m and one of m or m + 1 that part after p common code points lies in the one
group of those below whose free part [a, m - b) holds p; the last one, where b is 0, holds p = m as well. A
group of over GROUP words gives way to two: the one whose words share half of the free part too, and the one whose words
share the other half. The halves double with each round, so even words of one stem end in small groups, no pair is lost
or counted twice, and no group grows with the corpus: when one free place is left, a group has at most as many words as the
alphabet gives for two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import codepoints, cut, whole_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that one group may hold before it is parted, and rows of a tile.
GROUP, TILE = 256, 256


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, slips: int = 97) -> DataFrame:
    """(word, n) of the words of at least `least_length` code points that occur `least_count` times or more.

    Words are maximal runs of Latin letters with A-Z in lower case. If `slips` divides the checksum h of
    `<id>:<word>`, the word loses its code point h % length, as a slip of the pen. Null texts have no
    words, a null id is written as an empty one, repeated rows count again.
    """
    low = F.translate(F.col(text), UPPER, LOWER)
    runs = F.regexp_extract_all(low, F.lit("([a-zÀ-ÿ]{%d,})" % least_length), F.lit(1))
    each = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    h, size = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")), F.length("w")
    at = (h % size).cast("int")
    short = F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, size))
    word = F.when(h % slips == 0, short).otherwise(F.col("w"))
    return each.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, m, a, f) with the hash of their group; a hash that two groups share only costs comparisons."""
    b = F.col("m") - F.col("a") - F.col("f")
    shared = F.struct("m", "a", "f", F.substring("word", F.lit(1), F.col("a")).alias("p"), F.right("word", b).alias("s"))
    return rows.withColumn("key", F.xxhash64(shared))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two groups that part its own: first half of the free part shared, or the second."""
    h = F.floor(F.col("f") / 2).cast("int")
    two = F.array(F.struct((F.col("a") + h).alias("a"), (F.col("f") - h).alias("f")), F.struct(F.col("a").alias("a"), h.alias("f")))
    return rows.select("word", "n", "m", F.inline(two)).select("word", "n", "m", "a", "f")


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(key, m, a, f, word, n): every word in the groups that it belongs to, none of over `most` words but those with
    a single free place left.
    """
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    open_ = _keyed(_halves(both.withColumn("a", F.lit(0)).withColumn("f", F.col("m"))))
    done = None
    while True:
        open_ = cut(open_)
        large = open_.groupBy("key").agg(F.count("*").alias("held"), F.max("f").alias("most")).where((F.col("held") > most) & (F.col("most") > 1)).select("key")
        large = cut(large)
        last = large.isEmpty()
        small = open_ if last else open_.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done.select("key", "m", "a", "f", "word", "n")
        open_ = _keyed(_halves(open_.join(large, "key", "left_semi")))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, code points from the left, and from the right, padded with zeros to one column beyond the longest."""
    codes, at = codepoints(words)
    size = np.diff(at)
    left = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint32)
    right = left.copy()
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(at[:-1], size)
    left[row, place] = codes
    right[row, size[row] - 1 - place] = codes
    return size, left, right


def _common(a: np.ndarray, b: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Number of leading equal columns for each pair that is live."""
    out = np.zeros(live.shape, np.int32)
    live = live.copy()
    for x, y in zip(a.T, b.T, strict=True):
        live &= x[:, None] == y[None, :]
        if not live.any():
            break
        out += live
    return out


def near(tile: tuple, other: tuple) -> np.ndarray:
    """Which pairs of two tiles count: one edit apart, the first word of its group's m code points, parted in its free part.

    A tile is (key, m, a, f, size, left, right) of its rows. Rows of another group that shares the hash don't count.
    """
    key, m, a, f, size, left, right = tile
    key2, m2, a2, f2, size2, left2, right2 = other
    width = max(left.shape[1], left2.shape[1])
    left, right, left2, right2 = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (left, right, left2, right2))
    may = (key[:, None] == key2[None, :]) & (size == m)[:, None] & ((size2[None, :] - size[:, None]) >> 1 == 0)
    for x, y in ((m, m2), (a, a2), (f, f2)):
        may &= x[:, None] == y[None, :]
    if not may.any():
        return may
    prefix = _common(left, left2, may)
    suffix = _common(right, right2, may)
    longer = np.maximum(size[:, None], size2[None, :])
    last = (a + f == m)[:, None]
    inside = (prefix >= a[:, None]) & ((prefix < (a + f)[:, None]) | last)
    # equal words reach their whole length, padding included
    return may & (prefix + suffix >= longer - 1) & (prefix < longer) & inside


def _tiles(key: np.ndarray, rows: int) -> list[tuple[int, int, bool]]:
    """Ranges of about `rows` rows of sorted keys: whole groups together, or a part of one larger group (true)."""
    cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
    out, lo = [], 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - lo > rows and a > lo:
            out.append((lo, a, False))
            lo = a
        if b - a > rows:
            out += [(c, min(b, c + rows), True) for c in range(a, b, rows)]
            lo = b
    if lo < len(key):
        out.append((lo, len(key), False))
    return out


def links(grouped: DataFrame, rows: int = TILE) -> DataFrame:
    """(word, n_near, form_n, form) from rows of `groups`: how many near words there are, and the one of largest n, ties
    to the smaller word. Words without one give no row. A task holds a few whole groups at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 21):
            key, m, a, f, n = (table.column(c).to_numpy() for c in ("key", "m", "a", "f", "n"))
            words = table.column("word").to_pylist()
            count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))

            def opened(lo: int, hi: int) -> tuple:
                return (key[lo:hi], m[lo:hi], a[lo:hi], f[lo:hi], *_matrix(words[lo:hi]))  # noqa: B023

            def note(lo: int, lo2: int, found: np.ndarray) -> None:
                i = np.flatnonzero(found.any(1))
                count[lo + i] += found[i].sum(1)  # noqa: B023
                # rows of a group come by falling n, then by word: the first near one is the best
                best[lo + i] = np.minimum(best[lo + i], lo2 + found[i].argmax(1))  # noqa: B023

            cuts = _tiles(key, rows)
            for t, (lo, hi, parted) in enumerate(cuts):
                tile = opened(lo, hi)
                hit = near(tile, tile)
                note(lo, lo, hit | hit.T)  # the pairs of unequal lengths stand on one side only
                for lo2, hi2, _ in cuts[t + 1 :] if parted else ():
                    if key[lo2] != key[lo]:
                        break
                    other = opened(lo2, hi2)
                    hit = near(tile, other) | near(other, tile).T
                    note(lo, lo2, hit)
                    note(lo2, lo, hit.T)
            own = np.flatnonzero(count)
            if len(own):
                yield pa.RecordBatch.from_pydict({"word": table.column("word").take(own).combine_chunks(), "n_near": pa.array(count[own]), "form_n": pa.array(n[best[own]]), "form": table.column("word").take(best[own]).combine_chunks()})

    placed = grouped.repartition("key").sortWithinPartitions("key", F.desc("n"), "word")
    found = placed.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def with_roots(forms: DataFrame) -> DataFrame:
    """`forms` (word, form, ...) with `root`, where the forms lead to; each round doubles the steps taken.

    A form occurs at least twice as often as its word, so chains are short and never come back.
    """
    step = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = cut(step.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__on")))
        step = moved.select("word", "root")
        if moved.where("__on").isEmpty():
            break
    return forms.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    The form is the near word of largest n (ties to the smaller in code-point order) if that is at least
    `ratio` (two or more) times the word's own; else form and form_n are null. An empty table gives an empty one.
    """
    words = cut(words.select("word", "n"))
    found = links(groups(words, group)).withColumnsRenamed({"form": "__form", "form_n": "__form_n"})
    enough = F.col("__form_n") >= ratio * F.col("n")
    joined = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("__form")).alias("form"), F.when(enough, F.col("__form_n")).alias("form_n"))
    return with_roots(cut(joined)).select("word", "form", "root", "n", "n_near", "form_n")

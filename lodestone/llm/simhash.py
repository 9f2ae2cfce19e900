"""SimHash near-duplicates by self-joins of binary tries.

A fingerprint of `bits` bits is the majority vote of its shingles' hashes. Rows are dealt to groups, and each group's
fingerprints form a trie that is joined with itself: pairs of nodes are walked down together, their differing bits add
up, and a pair whose sum exceeds the budget is dropped with all below it. The walk goes depth first in slices of a
fixed size; what a slice links is united at once, and a pair of nodes that lie in one component already is dropped
too, so near copies cost about as much as other rows. A task returns stars, never all pairs.

Two ways give the groups:

* `section_nodes`: budget + 1 disjoint sections of the bits each root a trie. Fingerprints within the budget agree in
  one section at least, so no link is lost. It serves small budgets.
* `shingle_nodes`: a trie for each sampled shingle. A document takes part in the tries of the shingles that its hash
  functions sample; sets of similarity s share each sample with probability s, and sets without a common shingle
  never meet, so the work doesn't grow with the square of the table. It serves budgets that sections would need
  hundreds of tables for.

With a `similarity` what the tries link is only proposed: the members of each proposed component are compared by their
exact shingle sets (similarity.py), and these links alone count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestone.llm.common import cut, mix, ranges, runs, whole_groups
from lodestone.llm.components import connected_components
from lodestone.llm.similarity import similar_links

#: Rows of one group that a task compares at once; larger groups are dealt out as pairs of blocks.
BLOCK = 4096
#: Pairs of nodes in one slice of the walk, and pairs of rows below which a pair of nodes is settled row by row.
SLICE, LEAF = 1 << 14, 256
#: Sampled shingles that root a trie; twice as many further ones part crowded groups. A pair of similarity 0.8
#: shares none of four with a probability of 0.0016.
SAMPLES = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW_BITS = np.uint64(0x0101010101010101)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's shingles, one text after the other, and where each text's begin."""
    import xxhash

    xxh = xxhash.xxh64_intdigest
    hashes: list[int] = []
    at = [0]
    for text in texts:
        parts = text.encode().lower().split()
        joined = b" ".join(parts)
        n = len(parts)
        if n > words:
            sizes = np.fromiter(map(len, parts), np.int64, n)
            ends = np.cumsum(sizes + 1) - 1
            begin = (ends - sizes)[: n - words + 1].tolist()
            hashes += [xxh(joined[i:j], 42) for i, j in zip(begin, ends[words - 1 :].tolist(), strict=True)]
        elif n:
            hashes.append(xxh(joined, 42))
        at.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(at)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), each text's in order and once."""
    h, bounds = shingles(texts, words)
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([h[:0], *sets]), np.cumsum([0, *map(len, sets)])


def _lane(h: np.ndarray, word: int) -> np.ndarray:
    """64 hash bits of each shingle: XXH64 itself, or for further words that hash mixed with a constant."""
    return mix(h + np.full(1, word, np.uint64) * _GOLDEN) if word else h


def _majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text eight bytes, highest bit first: the bits that are set in over half of its hashes.

    Eight counters share a 64-bit word, one in each byte, so hashes are summed up 255 at a time.
    """
    counts = np.diff(bounds)
    out = np.zeros((len(counts), 8), np.uint8)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    chunks = -(-counts[rows] // 255)
    first = np.cumsum(chunks) - chunks
    at = np.repeat(bounds[:-1][rows], chunks) + 255 * (np.arange(int(chunks.sum())) - np.repeat(first, chunks))
    votes = np.zeros((len(at), 64), np.int32)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LOW_BITS, at)
        votes[:, 7 - k :: 8] = sums.astype(">u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(votes, first, axis=0)
    out[rows] = np.packbits(total * 2 > counts[rows, None], axis=1)
    return out


def fingerprints(texts: list[str], words: int, bits: int) -> np.ndarray:
    """Fingerprints as rows of bits / 8 bytes, highest bit first; a repeated shingle votes as often as it occurs."""
    h, bounds = shingles(texts, words)
    return np.concatenate([_majority(_lane(h, w), bounds) for w in range(bits // 64)], 1)


def simhash(docs: DataFrame, words: int = 5, bits: int = 64, text: str = "text") -> DataFrame:
    """`docs` without its text, with `fingerprint` (binary of bits / 8 bytes). No shuffle.

    Words are what lies between ASCII white space, with A-Z in lower case; a text of fewer words than a
    shingle is one shingle; a null or empty text has the fingerprint zero.
    """
    kept = [c for c in docs.columns if c not in (text, "fingerprint")]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("fingerprint", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in runs(texts):
                prints = pa.array([x.tobytes() for x in fingerprints(texts[a:b], words, bits)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], prints], [*part.schema.names[:-1], "fingerprint"])

    return source.mapInArrow(run, schema)


def set_prints(docs: DataFrame, words: int, bits: int, text: str = "text") -> DataFrame:
    """`docs` without its text, with the columns of its shingle set: `set_key` (16 bytes, equal for equal sets),
    `fingerprint` (each shingle votes once), `n_shingles` and `samples` (empty for an empty set): the smallest hash by
    each of bits / 64 hash functions, then the largest, then the smallest by as many functions again. No shuffle.
    """
    added = ["set_key", "fingerprint", "n_shingles", "samples"]
    source = docs.drop(*added).select(*[c for c in docs.columns if c not in (text, *added)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("set_key", "binary").add("fingerprint", "binary").add("n_shingles", "integer").add("samples", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in runs(texts):
                h, at = shingle_sets(texts[a:b], words)
                count = np.diff(at)
                some = np.flatnonzero(count)
                lanes = [_lane(h, w) for w in range(bits // 64)]
                prints = np.concatenate([_majority(x, at) for x in lanes], 1)
                more = [_lane(h, w) for w in range(bits // 64, bits // 32)]
                drawn = [(np.minimum, lanes), (np.maximum, lanes), (np.minimum, more)]
                samples = np.stack([f.reduceat(x, at[:-1][some]) for f, xs in drawn for x in xs], 1) if len(some) else np.zeros((0, 0), np.uint64)
                sizes = np.zeros(b - a + 1, np.int64)
                sizes[1:][some] = samples.shape[1]
                columns = [
                    pa.array([xxhash.xxh3_128_digest(h[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([x.tobytes() for x in prints], pa.binary()),
                    pa.array(count, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(samples.ravel().view(np.int64), pa.int64())),
                ]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *added])

    return source.mapInArrow(run, schema)


# The walk


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of each pair; `root` holds each row's smallest member."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def trie_components(prints: np.ndarray, groups: np.ndarray, budget: int, most: int = 1 << 20) -> np.ndarray:
    """For rows sorted by group, then bits: the first row of each one's component, where rows of one group link if
    at most `budget` of their bits differ. Small groups are walked together, about `most` pairs of rows at a time.
    """
    words = np.ascontiguousarray(prints).view(">u8").astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(groups)])
    work = np.cumsum(size.astype(np.int64) ** 2)
    root = np.arange(len(groups))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most)))
        a, b = int(starts[lo]), int(starts[hi - 1] + size[hi - 1])
        root[a:b] = a + _walk(words[a:b], prints[a:b], starts[lo:hi] - a, size[lo:hi], budget)
        lo = hi
    return root


def _walk(words: np.ndarray, prints: np.ndarray, starts: np.ndarray, size: np.ndarray, budget: int) -> np.ndarray:
    root = np.arange(len(words))
    bits = prints.shape[1] * 8
    for s, n in zip(starts[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        _lead(words[s : s + n], root[s : s + n], s, budget)
    node = np.stack([starts, starts + size], 1)
    stack = [(np.concatenate([node, node], 1), np.zeros(len(node), np.int64), 0)]
    while stack:
        pair, off, bit = stack.pop()
        if len(pair) > SLICE:
            stack += [(pair[SLICE:], off[SLICE:], bit), (pair[:SLICE], off[:SLICE], bit)]
            continue
        # a node lies in one component if the run of equal roots at its first row covers it
        ends = np.flatnonzero(np.r_[root[1:] != root[:-1], True]) + 1
        end = np.repeat(ends, np.diff(np.r_[0, ends]))
        a, b, c, d = pair.T
        alive = ~((end[a] >= b) & (end[c] >= d) & (root[a] == root[c]))
        pair, off = pair[alive], off[alive]
        a, b, c, d = pair.T
        leaf = (b - a) * (d - c) <= LEAF
        if bit == bits:
            # all bits are settled: everything under such a pair is linked
            for side, stop in ((a, b), (c, d)):
                unite(root, np.repeat(a, stop - side), ranges(side, stop - side))
            continue
        if leaf.any():
            _settle(words, root, pair[leaf], budget)
            pair, off = pair[~leaf], off[~leaf]
        if len(pair):
            stack.append((*_below(prints, pair, off, bit, budget), bit + 1))
    return root


def _lead(words: np.ndarray, root: np.ndarray, first: int, budget: int, leaders: int = 8) -> None:
    """Unite a large group's rows with a few of its own, so that a walk over near copies has little left to part.

    `root` is a view of the group's rows, with indices that begin at `first`.
    """
    own = root - first
    for _ in range(leaders):
        alone = np.flatnonzero(own == np.arange(len(own)))
        alone = alone[np.bincount(own, minlength=len(own))[alone] == 1]
        if not len(alone):
            break
        near = np.flatnonzero(np.bitwise_count(words ^ words[alone[0]]).sum(1) <= budget)
        unite(own, np.full(len(near), alone[0]), near)
    root[:] = own + first


def _settle(words: np.ndarray, root: np.ndarray, pair: np.ndarray, budget: int) -> None:
    """Compare the rows under small pairs of nodes one by one, about 2**18 at a time."""
    pairs = np.cumsum((pair[:, 1] - pair[:, 0]) * (pair[:, 3] - pair[:, 2]))
    for part in np.split(pair, np.searchsorted(pairs, np.arange(1 << 18, int(pairs[-1]), 1 << 18))):
        a, b, c, d = part.T
        wide = d - c
        count = (b - a) * wide
        k = ranges(np.zeros(len(count), np.int64), count)
        wide, i, j = np.repeat(wide, count), np.repeat(a, count), np.repeat(c, count)
        i, j = i + k // wide, j + k % wide
        want = (i < j) & (root[i] != root[j])
        i, j = i[want], j[want]
        near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= budget
        unite(root, i[near], j[near])


def _below(prints: np.ndarray, pair: np.ndarray, off: np.ndarray, bit: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children one bit further down that the budget leaves."""
    a, b, c, d = pair.T
    ones = np.r_[0, np.cumsum((prints[:, bit >> 3] >> (7 - (bit & 7))) & 1, dtype=np.int64)]
    mid_a, mid_c = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
    other = ~((a == c) & (b == d))  # a node with itself has its mixed pair once
    pair = np.concatenate([np.stack(x, 1) for x in ((a, mid_a, c, mid_c), (mid_a, b, mid_c, d), (a, mid_a, mid_c, d))] + [np.stack((mid_a, b, c, mid_c), 1)[other]])
    off = np.concatenate([off, off, off + 1, off[other] + 1])
    alive = (pair[:, 1] > pair[:, 0]) & (pair[:, 3] > pair[:, 2]) & (off <= budget)
    return pair[alive], off[alive]


# Groups, and the links within them


def section_nodes(prints: DataFrame, bits: int, budget: int) -> DataFrame:
    """(node, fingerprint, id) of `prints` (fingerprint, id): a group for each value of each section."""
    cuts = [bits * k // (budget + 1) for k in range(budget + 2)]
    roots = F.array(*(F.struct(F.lit(k).alias("section"), _bit_range("fingerprint", a, b - a).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    rows = prints.select("fingerprint", "id", F.explode(roots).alias("r")).select(F.xxhash64("r.section", "r.value").alias("node"), "fingerprint", "id")
    return in_blocks(rows)


def shingle_nodes(prints: DataFrame) -> DataFrame:
    """(node, fingerprint, id) of `prints` (fingerprint, id, n_shingles, samples): a group for each sampled shingle.

    A crowded group (a passage that very many documents hold) is parted by all further samples, eight of them, of which
    sets of a similarity of 0.8 share none with a probability of 0.0000026, and by the number of shingles, where each
    document goes to its own class and the next, since such sets differ by one class at most. What is crowded still
    (near copies) is dealt out as pairs of blocks.
    """
    first = F.slice("samples", 1, SAMPLES)
    rows = prints.select("fingerprint", "id", "n_shingles", F.slice("samples", SAMPLES + 1, 2 * SAMPLES).alias("more"), F.posexplode(first).alias("k", "sample"))
    rows = rows.withColumn("node", F.xxhash64("k", "sample")).drop("k", "sample")
    crowded = cut(rows.groupBy("node").count().where(F.col("count") > BLOCK).select("node", F.lit(True).alias("crowded")))
    if crowded.isEmpty():
        return rows.select("node", "fingerprint", "id")
    rows = rows.join(crowded, "node", "left")
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(1.26)))
    parts = F.flatten(F.transform("more", lambda x, k: F.array(F.xxhash64("node", k, x, size), F.xxhash64("node", k, x, size + 1))))
    return in_blocks(rows.select(F.explode(F.when(F.col("crowded"), parts).otherwise(F.array("node"))).alias("node"), "fingerprint", "id"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows with groups of more than BLOCK dealt out as pairs of blocks, so a task compares two blocks at most."""
    large = cut(rows.groupBy("node").count().where(F.col("count") > BLOCK).select("node", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if large.isEmpty():
        return rows
    rows = rows.join(large, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "fingerprint", "id")


def linked(rows: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) that connect the ids of `rows` (node, fingerprint, id) linked within a group by chains of pairs
    within the budget. Groups must be bounded (in_blocks).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, 4 << 20):
            node = found.column(0).to_numpy()
            values = np.frombuffer(b"".join(found.column(1).to_pylist()), np.uint8).reshape(len(node), -1)
            order = np.lexsort((*values.T[::-1], node))
            root = trie_components(np.ascontiguousarray(values[order]), node[order], budget)
            moved = np.flatnonzero(root != np.arange(len(root)))
            ids = found.column(2).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(order[root[moved]])), ids.take(pa.array(order[moved]))], ["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(compare, "a binary, b binary")


def _bit_range(column: str, first: int, length: int) -> Column:
    """Bits [first, first + length) of a binary, as a long; they must lie within seven bytes."""
    lo, hi = first // 8, -(-(first + length) // 8)
    if hi - lo > 7:
        raise ValueError("a section spans more than seven bytes")
    whole = F.conv(F.hex(F.substring(column, lo + 1, hi - lo)), 16, 10).cast("long")
    return F.shiftright(whole, hi * 8 - first - length).bitwiseAND(F.lit((1 << length) - 1))


# The operator


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 64, budget: int = 2, text: str = "text") -> DataFrame:
    """`docs` without its text, with `fingerprint` (binary), component_id, the smallest doc_id reachable by links
    of at most `budget` differing bits, and `root`, the component's smallest fingerprint.

    Exact: no link is lost. Null and empty texts have the fingerprint zero, linked like any other. Null ids are never
    the smallest, unless a component has no other; equal rows stay, in one component; columns named like the new
    ones are replaced; an empty table gives an empty one.
    """
    prints = cut(simhash(docs.drop("fingerprint", "component_id", "root"), words, bits, text))
    by = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = linked(section_nodes(by.select("fingerprint", F.col("fingerprint").alias("id")), bits, budget), budget)
    return _with_components(prints, by, links, "fingerprint")


def similar_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, budget: int = 64, text: str = "text") -> DataFrame:
    """`docs` without its text, with `fingerprint` (binary), component_id, the smallest doc_id reachable by links of
    texts whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more, and `root`, the
    set_key that names the component.

    Sets of a similarity of 0.8 differ in 15 % of the bits (39 of 256 with a deviation of 6; up to 19 % where
    sets have a few shingles only), so a budget of a quarter leaves two and a half deviations or more. A link is
    missed if its texts share no sampled shingle (0.0016 at 0.8) or exceed the budget; no pair under `similarity`
    links. (Sets that share a shingle with over BLOCK others need one of eight further samples too, which adds 0.0000026.)
    Null and empty texts are one component; null ids, equal rows, clashing names and empty tables as in
    near_duplicates.
    """
    clash = ("fingerprint", "component_id", "root", "set_key", "n_shingles", "samples", "__text_key")
    source = docs.drop(*clash).withColumn("__text_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    prints = cut(set_prints(source, words, bits, text))
    by = cut(prints.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("fingerprint").alias("fingerprint"), F.first("n_shingles").alias("n_shingles"), F.first("samples").alias("samples"), F.min("__text_key").alias("__text_key")))
    close = connected_components(linked(shingle_nodes(by.select("fingerprint", F.col("set_key").alias("id"), "n_shingles", "samples")), budget))
    members = cut(close.select(F.col("node").alias("set_key"), "root").join(by.select("set_key", "n_shingles", "__text_key"), "set_key"))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("__text_key", F.md5("text"))
    links = similar_links(members, texts, lambda t: shingle_sets(t, words), similarity)
    return _with_components(prints.drop("n_shingles", "samples", "__text_key"), by.select("set_key", "least"), links, "set_key").drop("set_key")


def _with_components(prints: DataFrame, by: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """`prints` with the component of each row's `key`; `by` has the smallest doc_id of each key."""
    roots = connected_components(links).withColumnRenamed("node", key)
    own = by.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(own.select(key, "root").join(least, "root").select(key, "component_id", "root"))
    return prints.join(found, key).select(*[c for c in prints.columns if c != "fingerprint"], "fingerprint", "component_id", "root")

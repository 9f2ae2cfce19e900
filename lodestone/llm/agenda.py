"""Merging by agenda, with seeded dropout: many pre-tokens' agendas are worked in step.

An agenda holds a pre-token's candidate merges by rank, then place. Its first entry is popped; if the candidate's
keyed hash falls below the dropout rate it is skipped for good, else the two symbols become one and the candidates
with its neighbours are pushed. Short pre-tokens of about the same length are rows of numpy matrices: in each step
every row pops its own first entry. Long ones have a heap each. Both give the same merges.
"""

from __future__ import annotations

import heapq

import numpy as np

from lodestone.llm.bpe import NO_RANK, PieceVocabulary
from lodestone.llm.common import mix, ranges

#: Characters of the longest pre-token that is worked in a matrix, and cells of a matrix.
WIDEST, CELLS = 64, 1 << 19

#: Symbol, first character, characters and pre-token of each symbol that survives.
Merged = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def skipped(key: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    """Whether the candidate that joins `left` and `right` characters at `start` is skipped."""
    x = mix(key ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    x = mix(x + (left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 < p


def work_agendas(v: PieceVocabulary, codes: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None, p: float = 0.0) -> tuple[Merged, Merged]:
    """Merge every pre-token to its end; `codes` holds the pre-tokens one after the other.

    The first result has the survivors, by pre-token and place. The second has what was popped: pre-token, place,
    and characters of both sides. Without `keys` (one for each pre-token) nothing is skipped.
    """
    begin = np.cumsum(lengths) - lengths
    left, popped = [], []
    width = 1
    while width < WIDEST:
        narrow, width = width if width > 1 else 0, width * 2
        rows = np.flatnonzero((lengths > narrow) & (lengths <= width))
        for k in range(0, len(rows), CELLS // width):
            some = rows[k : k + CELLS // width]
            _in_step(v, codes, begin[some], lengths[some], some, None if keys is None else keys[some], p, left, popped)
    for n in np.flatnonzero(lengths > WIDEST).tolist():
        _by_heap(v, codes[begin[n] : begin[n] + lengths[n]], n, None if keys is None else keys[n : n + 1], p, left, popped)
    none = (np.zeros(0, np.int64),) * 4
    sym, at, size, seq = (np.concatenate(x) for x in zip(none, *left, strict=True))
    order = np.lexsort((at, seq))
    return (sym[order], at[order], size[order], seq[order]), tuple(np.concatenate(x) for x in zip(none, *popped, strict=True))


def _in_step(v: PieceVocabulary, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, seq: np.ndarray, keys: np.ndarray | None, p: float, left: list[Merged], popped: list[Merged]) -> None:
    width = int(length.max())
    place = np.arange(width)
    inside = place < length[:, None]
    # one more column stands for what lies beyond the end
    sym = np.full((len(seq), width + 1), -1, np.int64)
    sym[:, :width][inside] = v.char_id[codes[(begin[:, None] + place)[inside]]]
    size = np.zeros((len(seq), width + 1), np.int64)
    size[:, :width][inside] = 1
    after = np.tile(np.arange(1, width + 2), (len(seq), 1))
    after[np.arange(len(seq)), length - 1] = width
    before = np.tile(np.arange(-1, width), (len(seq), 1))
    rank = np.full((len(seq), width + 1), NO_RANK, np.int32)
    made = np.full((len(seq), width + 1), -1, np.int32)
    rank[:, :-1], made[:, :-1] = v.look_up(sym[:, :-1], sym[:, 1:])
    while len(seq):
        every = np.arange(len(seq))
        top = rank.argmin(1)
        live = rank[every, top] < NO_RANK
        if live.sum() < 0.7 * len(live):
            row, at = np.nonzero(size[~live])
            left.append((sym[~live][row, at], at, size[~live][row, at], seq[~live][row]))
            sym, size, after, before, rank, made, seq, top = (x[live] for x in (sym, size, after, before, rank, made, seq, top))
            keys = None if keys is None else keys[live]
            row = np.arange(len(seq))
        else:
            row, top = every[live], top[live]
        if not len(row):
            continue
        other = after[row, top]
        popped.append((seq[row], top, size[row, top], size[row, other]))
        if keys is not None:
            skip = skipped(keys[row], top, size[row, top], size[row, other], p)
            rank[row[skip], top[skip]] = NO_RANK
            row, top, other = row[~skip], top[~skip], other[~skip]
        sym[row, top] = made[row, top]
        size[row, top] += size[row, other]
        size[row, other] = 0
        rank[row, other] = NO_RANK
        then, back = after[row, other], before[row, top]
        after[row, top] = then
        before[row, then] = top
        rank[row, top], made[row, top] = v.look_up(sym[row, top], sym[row, then])
        has = back >= 0
        row, top, back = row[has], top[has], back[has]
        rank[row, back], made[row, back] = v.look_up(sym[row, back], sym[row, top])


def _by_heap(v: PieceVocabulary, codes: np.ndarray, seq: int, key: np.ndarray | None, p: float, left: list[Merged], popped: list[Merged]) -> None:
    n = len(codes)
    sym = [*v.char_id[codes].tolist(), -1]
    size, after, before = [1] * n + [0], list(range(1, n + 1)), list(range(-1, n))
    rank, made = (x.tolist() for x in v.look_up(np.array(sym[:-1]), np.array(sym[1:])))
    pairs = _pairs(v)
    heap = [(rank[i], i, 1, 1, made[i]) for i in range(n) if rank[i] < NO_RANK]
    heapq.heapify(heap)
    tried = []

    def push(i: int) -> None:
        j = after[i]
        if found := pairs.get((sym[i], sym[j])):
            heapq.heappush(heap, (found[0], i, size[i], size[j], found[1]))

    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = after[i] if size[i] else n
        if size[i] != a or size[j] != b:
            continue  # one side has grown meanwhile
        tried.append((i, a, b))
        if key is not None and skipped(key, *(np.array([x]) for x in (i, a, b)), p)[0]:
            continue
        sym[i], size[i], size[j], after[i] = piece, a + b, 0, after[j]
        before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    at = np.flatnonzero(np.array(size[:n]))
    left.append((np.array(sym)[at], at, np.array(size)[at], np.full(len(at), seq)))
    if tried:
        i, a, b = np.array(tried).T
        popped.append((np.full(len(i), seq), i, a, b))


def _pairs(v: PieceVocabulary) -> dict[tuple[int, int], tuple[int, int]]:
    """Rank and merged symbol of every pair, as a dictionary; kept with the vocabulary."""
    if not hasattr(v, "pairs"):
        left, right = np.divmod(v.keys, v.width)
        v.pairs = dict(zip(zip(left.tolist(), right.tolist(), strict=True), zip(v.made_rank.tolist(), v.made.tolist(), strict=True), strict=True))
    return v.pairs


def drawing(popped: Merged, n: int, which: np.ndarray, keys: np.ndarray, p: float) -> np.ndarray:
    """Of places (pre-token `which` of n, key): those at which one candidate of the popped ones is skipped, or more."""
    seq, at, left, right = popped
    order = np.argsort(seq, kind="stable")
    at, left, right = at[order], left[order], right[order]
    count = np.bincount(seq, minlength=n)
    first = np.cumsum(count) - count
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(which), 1 << 15):
        w = which[lo : lo + (1 << 15)]
        c = ranges(first[w], count[w])
        hit = np.flatnonzero(skipped(np.repeat(keys[lo : lo + (1 << 15)], count[w]), at[c], left[c], right[c], p))
        found.append(lo + np.unique(np.repeat(np.arange(len(w)), count[w])[hit]))
    return np.concatenate(found)

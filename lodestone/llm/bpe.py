"""Rank-synchronous merging of ragged symbol arrays, for sentencepiece BPE models.

A text is cut wherever no piece of the vocabulary holds the two characters side by side: no merge can
cross such a place, so the parts (pre-tokens) can be merged apart from each other and repeated ones once.
The distinct pre-tokens of a batch lie one after the other in flat numpy arrays. In each round every
pre-token applies its lowest-rank pair, all pre-tokens at the same time; those without a pair drop out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lodestone.llm.common import codepoints, ranges, segment_hashes, sums_between

NO_RANK = np.int32(2**31 - 1)
SPACE = "\u2581"


class PieceVocabulary:
    """Pieces, merge ranks and cut places of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {self.pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        for char in {c for p in ids for c in p}:  # characters that are no piece can still begin a merge
            ids.setdefault(char, self.size + len(ids))
        self.char_id = np.full(0x110000, -1, np.int32)
        dense, side = np.zeros(0x110000, np.int32), set()
        pairs: dict[tuple[int, int], int] = {}
        self.shy = np.zeros(max(ids.values()) + 1, bool)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            side.update(zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                for part in (a, b):
                    # a merge that makes this part may open a pair of lower rank: take its places one by one
                    if part is not None and rank.get(part, -1) > rank[i]:
                        self.shy[part] = True
        chars = sorted({c for ab in side for c in ab})
        dense[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.dense = dense
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in side:
            self.beside[dense[ord(a)], dense[ord(b)]] = True
        self.width = np.int64(max(ids.values()) + 1)
        keys = np.array([a * int(self.width) + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], np.array(list(pairs.values()), np.int32)[by]
        ranks = np.full(int(self.width), NO_RANK, np.int32)
        ranks[list(rank)] = list(rank.values())
        self.made_rank = ranks[self.made]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where no piece is made."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.made_rank[at], NO_RANK), np.where(hit, self.made[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def cut_places(v: PieceVocabulary, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start."""
    first = np.ones(len(codes), bool)
    if len(codes) > 1:
        d = v.dense[codes]
        first[1:] = ~v.beside[d[:-1], d[1:]]
    first[bounds[:-1][bounds[:-1] < len(codes)]] = True
    return np.flatnonzero(first)


def merged(v: PieceVocabulary, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge every pre-token to its end: symbol, first character, characters and pre-token of each survivor.

    `codes` holds the pre-tokens one after the other.
    """
    n = len(lengths)
    seq = np.repeat(np.arange(n), lengths)
    begin = np.cumsum(lengths) - lengths
    at = np.arange(len(codes)) - np.repeat(begin, lengths)
    sym, size = v.char_id[codes], np.ones(len(codes), np.int64)
    done: list[tuple[np.ndarray, ...]] = []

    def rank_of(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs (i, i + 1); i + 1 may belong to the next pre-token."""
        j = np.minimum(i + 1, len(sym) - 1)
        r, made = v.look_up(sym[i], sym[j])
        r[(seq[i] != seq[j]) | (i == j)] = NO_RANK
        return r, made

    if len(sym):
        rank, made = rank_of(np.arange(len(sym)))
    while len(sym):
        start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        count = np.diff(np.r_[start, len(sym)])
        best = np.minimum.reduceat(rank, start)
        live = best < NO_RANK
        if not live.all():
            over = np.repeat(~live, count)
            done.append((sym[over], at[over], size[over], seq[over]))
            sym, at, size, seq, rank, made = (x[~over] for x in (sym, at, size, seq, rank, made))
            count, best = count[live], best[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, count))
        # of overlapping places the left one is taken, as in an agenda ordered by rank, then place
        breaks = np.r_[True, hit[1:] != hit[:-1] + 1]
        lead = np.maximum.accumulate(np.where(breaks, np.arange(len(hit)), 0))
        take = (np.arange(len(hit)) - lead) % 2 == 0
        firsts = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
        take &= firsts | ~v.shy[made[hit]]
        hit = hit[take]
        sym[hit] = made[hit]
        size[hit] += size[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        where = np.cumsum(keep) - 1
        sym, at, size, seq, rank, made = (x[keep] for x in (sym, at, size, seq, rank, made))
        new = where[hit]
        back = new[(new > 0)] - 1
        again = np.unique(np.r_[new, back[seq[back] == seq[back + 1]]])
        rank[again], made[again] = rank_of(again)
    if not done:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    sym, at, size, seq = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(seq, kind="stable")
    return sym[order], at[order], size[order], seq[order]


def distinct(codes: np.ndarray, starts: np.ndarray):
    """Distinct pre-tokens: their codes and lengths, the hash of each, and which one stands at each place.

    Pre-tokens of equal 64-bit hash and length count as equal within a batch of about two million characters.
    """
    lengths = np.diff(np.r_[starts, len(codes)])
    hashes = segment_hashes(codes, starts, lengths)
    own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return codes[ranges(starts[first], lengths[first])], lengths[first], own, which


def _utf8_bytes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def count_tokens(v: PieceVocabulary, texts: list[str]) -> np.ndarray:
    """Tokens of each text; a character outside the vocabulary counts its UTF-8 bytes."""
    codes, bounds = codepoints([v.processor.normalize(t) if t else "" for t in texts])
    starts = cut_places(v, codes, bounds)
    own, lengths, _, which = distinct(codes, starts)
    sym, at, _, seq = merged(v, own, lengths)
    begin = np.cumsum(lengths) - lengths
    cost = np.ones(len(sym), np.int64)
    strange = np.flatnonzero((sym < 0) | (sym >= v.size))
    cost[strange] = _utf8_bytes(own[begin[seq[strange]] + at[strange]])
    each = np.bincount(seq, weights=cost, minlength=len(lengths)).astype(np.int64)
    return sums_between(each[which], np.searchsorted(starts, bounds))

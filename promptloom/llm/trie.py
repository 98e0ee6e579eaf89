"""Counting tokens without making them: a double-array trie over a vocabulary and a best-path search of counts.

All vocabulary entries at all positions of a batch of segments are found by array steps through the trie; the
paths of all segments advance together. For a unigram vocabulary the path of the highest score counts. For a
vocabulary of merges the one path counts on which no two neighbours would have merged otherwise: that path
is what the merges give, so the count is exact without carrying them out.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np

from promptloom.llm import arrowtext as at
from promptloom.llm import bpe


class DoubleArray:
    """Entries of code points in two arrays: child(state, c) is base[state] + c if check there is state."""

    def __init__(self, entries: dict[str, int]):
        number_of = Counter(c for e in entries for c in e)
        chars = sorted(number_of, key=lambda c: (-number_of[c], c))
        self.code = np.zeros(at.MAX_CP, np.int64)
        for k, c in enumerate(chars, 1):
            self.code[ord(c)] = k
        tree: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for entry, number in entries.items():
            node = 0
            for c in self.code[[ord(x) for x in entry]].tolist():
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                    value.append(-1)
                node = tree[node][c]
            value[node] = number
        size = len(tree) + 4 * (len(chars) + 2)
        used = np.zeros(size, bool)
        used[0] = True
        slot_of, base_of = np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)
        cursor = 1
        order = sorted((n for n in range(len(tree)) if len(tree[n]) > 1), key=lambda n: -len(tree[n]))  # crowded nodes first
        for node in order:
            codes = np.array(list(tree[node]), np.int64)
            low, k = codes.min(), cursor
            while True:  # free slots for the lowest child, some at once
                if k + len(chars) + 257 >= len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                free = np.flatnonzero(~used[k : k + 256]) + k
                at_base = free[free >= low] - low
                fits = np.flatnonzero(~used[at_base[:, None] + codes[None, :]].any(axis=1))
                if len(fits):
                    break
                if k == cursor and (len(free) < 128 or len(codes) == 2):  # crowded: left to the only children
                    cursor += 256
                k += 256
            b = base_of[node] = at_base[fits[0]]
            used[b + codes] = True
            slot_of[list(tree[node].values())] = b + codes
        # an only child fits anywhere: all of them take the free slots that are left
        single = np.array([n for n in range(len(tree)) if len(tree[n]) == 1], np.int64)
        codes = np.array([next(iter(tree[n])) for n in single.tolist()], np.int64)
        used = np.concatenate([used, np.zeros(len(single) + len(chars) + 1, bool)])
        free = np.flatnonzero(~used)
        slots = free[free > len(chars)][: len(single)]
        base_of[single] = slots - codes
        slot_of[[next(iter(tree[n].values())) for n in single.tolist()]] = slots
        self.base, self.check, self.end = np.zeros(len(used), np.int64), np.full(len(used), -1, np.int64), np.full(len(used), -1, np.int64)
        self.base[slot_of], self.end[slot_of] = base_of, value
        for node in (*order, *single.tolist()):
            self.check[slot_of[list(tree[node].values())]] = slot_of[node]

    def matches(self, cps: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: starts and entries of the matches; ``ends`` has the end of each position's segment."""
        code = self.code[cps]
        place, state = np.arange(len(cps)), np.zeros(len(cps), np.int64)
        out, size = [], 0
        while len(place):
            size += 1
            c = code[place + size - 1]
            child = self.base[state] + c
            ok = (c > 0) & (self.check[np.minimum(child, len(self.check) - 1)] == state)
            place, state = place[ok], child[ok]
            hit = self.end[state] >= 0
            out.append((place[hit], self.end[state][hit]))
            more = place + size < ends[place]
            place, state = place[more], state[more]
        return out


class MergeCheck:
    """Whether merges leave two neighbouring entries apart: undo the later merge of the two, as long as there is one."""

    def __init__(self, tokenizer: bpe.PieceTokenizer):
        self.pairs = tokenizer.pairs
        size = tokenizer.size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.reached = np.zeros(size, bool)
        table = {}
        used = np.flatnonzero(self.pairs.keys >= 0)
        for key, rank, merged in zip(self.pairs.keys[used].tolist(), self.pairs.rank[used].tolist(), self.pairs.merged[used].tolist()):
            table[key >> 32, key & 0xFFFFFFFF] = (rank, merged)
        for piece, number in tokenizer.pieces.items():
            symbols = [tokenizer.pieces.get(c, -1) for c in piece]
            last = None
            while len(symbols) > 1:
                found = [(table[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in table]
                if not found:
                    break
                rank, k = min(found)
                last = (rank, symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [table[symbols[k], symbols[k + 1]][1]]
            if symbols == [number]:
                self.reached[number] = True
                if last:
                    self.rank[number], self.left[number], self.right[number] = last

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        result = np.ones(len(first), bool)
        todo = np.arange(len(first))
        a, b = first.copy(), second.copy()
        limit = np.full(len(first), np.int64(1) << 40)
        while len(todo):
            slot = self.pairs.find(a, b)
            joins = (slot >= 0) & (self.pairs.rank[slot] < limit)
            result[todo[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return result


class TrieCounter(bpe.Tokenizer):
    """Counts of a piece vocabulary. ``scores`` makes it a unigram vocabulary; without, its merges decide."""

    def __init__(self, tokenizer: bpe.PieceTokenizer, scores: np.ndarray | None = None):
        super().__init__()
        self.tokenizer, self.scores = tokenizer, scores
        self.check = MergeCheck(tokenizer) if scores is None else None
        pieces = tokenizer.pieces if self.check is None else {p: i for p, i in tokenizer.pieces.items() if self.check.reached[i]}
        self.trie = DoubleArray(pieces)

    def segments(self, cps, offs):
        return self.tokenizer.segments(cps, offs)

    def encode_segments(self, values, starts, ends):
        """No ids, only sizes: the store keeps counts alone."""
        lens = ends - starts
        counts = np.zeros(len(lens), np.int64)
        order = np.argsort(-lens, kind="stable")
        k = 0
        while k < len(order):  # segments of like length together, in pieces of bounded size
            step = max(1, 400_000 // max(1, int(lens[order[k]])))
            own = order[k : k + step]
            counts[own] = self._count(values[at.ragged_index(starts[own], lens[own])], at.offsets(lens[own]))
            k += step
        return np.zeros(0, np.int32), at.offsets(counts)

    def _count(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        lens = np.diff(offs)
        end = np.repeat(offs[1:], lens)
        start = np.repeat(offs[:-1], lens)
        # one node more than signs for each segment: node of position p of segment s is p + s
        shift = np.repeat(np.arange(len(lens)), lens)
        total = len(cps) + len(lens)
        count = np.zeros(total, np.int64)
        entry = np.full(total, -2, np.int64)  # -2: not reached, -1: before the first or after a sign without an entry
        entry[offs[:-1] + np.arange(len(lens))] = -1
        best = np.full(total, -np.inf)
        best[offs[:-1] + np.arange(len(lens))] = 0.0
        found = self.trie.matches(cps, end)
        alone = self.trie.code[cps] == 0
        if len(found):
            alone[found[0][0]] = False
            strange = np.ones(len(cps), bool)
            strange[found[0][0]] = False
            alone |= strange
        lost = np.flatnonzero(alone)
        cost = at.utf8_lengths(cps)
        by_offset: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[] for _ in range(int(lens.max(initial=0)))]
        for size, (place, number) in [*enumerate(found, 1), (0, (lost, np.full(len(lost), -1)))]:
            rank = place - start[place]
            order = np.argsort(rank, kind="stable")
            cut = np.searchsorted(rank[order], np.arange(len(by_offset) + 1))
            for o in np.flatnonzero(np.diff(cut)).tolist():
                pick = order[cut[o] : cut[o + 1]]
                by_offset[o].append((place[pick], number[pick], size))
        for edges in by_offset:
            for place, number, size in edges:
                node = place + shift[place]
                if self.scores is None:
                    before = entry[node]
                    ok = before > -2
                    both = np.flatnonzero((before >= 0) & (number >= 0))
                    ok[both] = self.check.apart(before[both], number[both])
                    place, number, node = place[ok], number[ok], node[ok]
                    to = node + max(1, size)
                    entry[to] = number
                    count[to] = count[node] + (1 if size else cost[place])
                else:
                    score = best[node] + (self.scores[number] if size else -1e6)
                    to = node + max(1, size)
                    better = score > best[to]
                    to, node = to[better], node[better]
                    best[to] = score[better]
                    count[to] = count[node] + (1 if size else cost[place[better]])
        return count[offs[1:] + np.arange(len(lens))]


@functools.lru_cache(maxsize=4)
def load(name: str, folder: str = bpe.TOKENIZER_DIR) -> TrieCounter:
    """The counter of a public piece vocabulary; one per worker process."""
    tokenizer = bpe.load(name, folder)
    if not isinstance(tokenizer, bpe.PieceTokenizer):
        raise ValueError(f"{name!r} is no piece vocabulary")
    return TrieCounter(tokenizer)

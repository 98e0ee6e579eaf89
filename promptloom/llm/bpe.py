"""Byte-pair encoding of whole batches with a public vocabulary.

Texts become flat arrays; equal pre-tokens are encoded once. The merges of all distinct pre-tokens of
one width run side by side: each has a segment tree over the ranks of its adjacent pairs, whose root is
the leftmost pair of lowest rank. A merge rewrites three leaves and their paths, until no pair is left.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata

import numpy as np

from promptloom.llm import arrowtext as at

TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct pre-tokens that a worker keeps encoded; beyond it the store starts afresh (speed only).
STORE_ENTRIES = 400_000
_NONE = np.int64(1) << np.int64(62)


class PairRanks:
    """(left id, right id) -> id of the merged symbol; the id orders the merges. Open addressing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merged = np.full(size, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            at_slot, item = slot[won], todo[won]
            self.keys[at_slot], self.rank[at_slot], self.merged[at_slot] = keys[item], rank[item], merged[item]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got >= 0)]
        return out


def merge_all(symbols: np.ndarray, offs: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of every row to the end; flat ids and the rows' new offsets."""
    lens = np.diff(offs)
    new_lens = lens.copy()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    short = np.flatnonzero(lens < 2)
    if len(short):
        parts.append((short, symbols[at.ragged_index(offs[short], lens[short])]))
    widths = np.zeros(len(lens), np.int64)
    long_ = lens >= 2
    widths[long_] = 1 << np.ceil(np.log2(np.maximum(1, lens[long_] - 1))).astype(np.int64)
    for width in np.unique(widths[long_]):
        rows = np.flatnonzero(widths == width)
        step = max(1, (1 << 21) // int(width))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            ids, n = _merge_block(symbols, offs[own], lens[own], int(width), pairs)
            new_lens[own] = n
            parts.append((own, ids))
    new_offs = at.offsets(new_lens)
    out = np.empty(int(new_offs[-1]), np.int64)
    for rows, ids in parts:
        out[at.ragged_index(new_offs[rows], new_lens[rows])] = ids
    return out, new_offs


def _merge_block(symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    count, cols = len(starts), width + 1
    cell = np.arange(cols)[None, :]
    inside = cell < lens[:, None]
    sym = np.zeros((count, cols), np.int64)
    sym[inside] = symbols[at.ragged_index(starts, lens)]
    alive = inside.copy()
    after = np.where(cell + 1 < lens[:, None], cell + 1, -1)
    before = np.where(inside, cell - 1, -1)
    tree = np.full((count, 2 * width), _NONE, np.int64)
    tree[:, width:] = _leaves(sym[:, :-1], sym[:, 1:], after[:, :-1] >= 0, np.broadcast_to(cell[:, :-1], (count, width)), pairs)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        top = tree[rows, 1]
        left = top & 0xFFFFFFF
        right = after[rows, left]
        sym[rows, left] = pairs.merged[pairs.find(sym[rows, left], sym[rows, right])]
        alive[rows, right] = False
        next_ = after[rows, right]
        after[rows, left] = next_
        has_next, prev = next_ >= 0, before[rows, left]
        before[rows[has_next], next_[has_next]] = left[has_next]
        has_prev = prev >= 0
        tree[rows[right < width], width + right[right < width]] = _NONE
        tree[rows, width + left] = _leaves(sym[rows, left], sym[rows, np.maximum(next_, 0)], has_next, left, pairs)
        r2, p2, l2 = rows[has_prev], prev[has_prev], left[has_prev]
        tree[r2, width + p2] = _leaves(sym[r2, p2], sym[r2, l2], np.ones(len(r2), bool), p2, pairs)
        touched = ((rows, (width + left) >> 1), (rows, (width + np.minimum(right, width - 1)) >> 1), (r2, (width + p2) >> 1))
        depth = width.bit_length() - 1
        for _ in range(depth):
            for r, node in touched:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            touched = tuple((r, node >> 1) for r, node in touched)
        rows = rows[tree[rows, 1] < _NONE]
    return sym[alive], alive.sum(axis=1)


def _leaves(left: np.ndarray, right: np.ndarray, real: np.ndarray, position: np.ndarray, pairs: PairRanks) -> np.ndarray:
    slot = pairs.find(left.ravel(), right.ravel()).reshape(left.shape)
    return np.where(real & (slot >= 0), (pairs.rank[slot] << 28) | position, _NONE)


class _Classes:
    """Character classes of the pre-tokenizer, filled for code points as they come: 1 letter, 2 number, 3 space, 4 other."""

    def __init__(self):
        self.table = np.zeros(at.MAX_CP, np.uint8)

    def of(self, cps: np.ndarray) -> np.ndarray:
        out = self.table[cps]
        if len(out) and not out.all():
            for cp in np.unique(cps[out == 0]).tolist():
                kind = unicodedata.category(chr(cp))[0]
                space = chr(cp).isspace() and not 0x1C <= cp <= 0x1F
                self.table[cp] = 3 if space else 1 if kind == "L" else 2 if kind == "N" else 4
            out = self.table[cps]
        return out


_classes = _Classes()


def pretoken_starts(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens that the public pattern of the byte vocabularies finds, in all rows at once.

    Contractions; letters, numbers or other signs, each with at most one space before; spaces, of which
    the last goes to what follows.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes.of(cps)
    row_start = np.zeros(n + 1, bool)
    row_start[offs] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= row_start[:n]
    space = kind == 3
    last_of_run = np.empty(n, bool)
    last_of_run[-1] = True
    last_of_run[:-1] = start[1:]
    # a run of spaces before other text gives up its last sign: to the next token if it is a blank
    gives = space & last_of_run & ~row_start[1:]
    blank = gives & (cps == 0x20)
    start |= gives
    taken = np.flatnonzero(blank) + 1
    start[taken] = False
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        end = np.searchsorted(offs, quote, "right")
        room = offs[end] - quote - 1
        c1 = np.where(room > 0, cps[np.minimum(quote + 1, n - 1)], 0)
        c2 = np.where(room > 1, cps[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        for at_, size in ((quote[one], 1), (quote[two & ~one], 2)):
            start[at_ + 1] = False
            rest = at_ + 1 + size
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


class _Store:
    """Encoded pre-tokens of this worker, by hash: where their ids lie in one growing array."""

    def __init__(self):
        self.where: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def add(self, hashes: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> None:
        k, n = len(self.where), len(hashes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[k : k + n], self.size[k : k + n] = offs[:-1] + self.used, np.diff(offs)
        self.used += len(ids)
        self.where.update(zip(hashes.tolist(), range(k, k + n)))


class Tokenizer:
    """What the byte and the piece vocabularies share: encode distinct pre-tokens once, gather the rest."""

    pairs: PairRanks

    def __init__(self):
        self.store = _Store()

    def segments(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat values, starts of the segments, and for each row its first segment's number."""
        raise NotImplementedError

    def encode_segments(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _slots(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, starts, rows = self.segments(cps, offs)
        if not len(starts):
            return np.zeros(0, np.int64), rows
        ends = np.append(starts[1:], len(values))
        uniq, first, inverse = np.unique(at.segment_hashes(values, starts, ends), return_index=True, return_inverse=True)
        # equal hashes must mean equal segments: compare every segment with the one that stands for it
        lens = ends - starts
        same = lens == lens[first][inverse]
        twin = at.ragged_index(starts[first][inverse], lens)
        if not same.all() or not (values == values[twin]).all():
            raise ValueError("two different segments have one 64-bit hash")
        if len(self.store.where) > STORE_ENTRIES:
            self.store = _Store()
        known = list(map(self.store.where.get, uniq.tolist()))
        new = np.flatnonzero(np.fromiter((x is None for x in known), bool, len(known)))
        if len(new):
            s = first[new]
            ids, id_offs = self.encode_segments(values, starts[s], ends[s])
            self.store.add(uniq[new], ids, id_offs)
            known = list(map(self.store.where.get, uniq.tolist()))
        return np.array(known, np.int64)[inverse], rows

    def encode(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (int32) of all rows, flat, and the rows' offsets."""
        slots, rows = self._slots(cps, offs)
        sizes = self.store.size[slots]
        return self.store.pool[at.ragged_index(self.store.first[slots], sizes)], at.offsets(sizes)[rows]

    def count(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        slots, rows = self._slots(cps, offs)
        return np.diff(at.offsets(self.store.size[slots])[rows])


class ByteTokenizer(Tokenizer):
    """A rank file of byte sequences: the merge of a pair has the rank of the bytes it makes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        merged_ = np.array(merged, np.int64)
        self.pairs = PairRanks(np.array(left, np.int64), np.array(right, np.int64), merged_, merged_)

    def segments(self, cps, offs):
        starts = pretoken_starts(cps, offs)
        return cps, starts, np.searchsorted(starts, offs)

    def encode_segments(self, values, starts, ends):
        lens = ends - starts
        own = values[at.ragged_index(starts, lens)]
        byte_offs = at.offsets(at.utf8_lengths(own))[at.offsets(lens)]
        return merge_all(self.of_byte[at.to_utf8(own)], byte_offs, self.pairs)


class PieceTokenizer(Tokenizer):
    """A piece vocabulary with scores: pairs of pieces merge by the score of what they make; letters that no
    piece has end as bytes. Text is taken as it is; a blank is U+2581, one more stands before the text."""

    BLANK = 0x2581

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(chr(self.BLANK) in p.lstrip(chr(self.BLANK)) for p in pieces):
            raise ValueError("a piece has a blank inside: its texts can't be cut at blanks")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = {i: model.get_score(i) for i in pieces.values()}
        order = {i: k for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)))}
        self.pieces, self.size = pieces, size
        self.of_char = np.full(at.MAX_CP, -1, np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbols = dict(pieces)
        for ch in {c for p in pieces for c in p} - pieces.keys():
            symbols[ch] = size + ord(ch)
        left, right, merged = [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        m = np.array(merged, np.int64)
        self.pairs = PairRanks(np.array(left, np.int64), np.array(right, np.int64), m, np.array([order[i] for i in merged], np.int64))

    def with_blanks(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blanks as U+2581, one of them before each text that is not empty."""
        lens = np.diff(offs)
        new_lens = lens + (lens > 0)
        new_offs = at.offsets(new_lens)
        out = np.full(int(new_offs[-1]), self.BLANK, np.uint32)
        out[at.ragged_index(new_offs[:-1] + (lens > 0), lens)] = np.where(cps == 0x20, self.BLANK, cps)
        return out, new_offs

    def segments(self, cps, offs):
        values, offs = self.with_blanks(cps, offs)
        blank = values == self.BLANK
        start = np.zeros(len(values) + 1, bool)
        start[1:-1] = blank[1:] & ~blank[:-1]
        start[offs] = True
        starts = np.flatnonzero(start[:-1])
        return values, starts, np.searchsorted(starts, offs)

    def encode_segments(self, values, starts, ends):
        lens = ends - starts
        own = values[at.ragged_index(starts, lens)].astype(np.int64)
        symbol = self.of_char[own]
        symbol = np.where(symbol < 0, self.size + own, symbol)
        ids, offs = merge_all(symbol, at.offsets(lens), self.pairs)
        strange = ids >= self.size
        if not strange.any():
            return ids, offs
        chars = (ids[strange] - self.size).astype(np.uint32)
        sizes = np.ones(len(ids), np.int64)
        sizes[strange] = at.utf8_lengths(chars)
        new = at.offsets(sizes)
        out = np.repeat(ids, sizes)
        out[np.repeat(strange, sizes)] = self.byte_ids[at.to_utf8(chars)]
        return out, new[offs]


@functools.lru_cache(maxsize=8)
def load(name: str, folder: str = TOKENIZER_DIR) -> Tokenizer:
    """A public tokenizer by its name; one per worker process."""
    if name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        return ByteTokenizer(f"{folder}/{name}.tiktoken")
    if name == "piece_bpe_32k":
        return PieceTokenizer(f"{folder}/{name}.model")
    raise ValueError(f"no batch encoder for tokenizer {name!r}")


assert sys.byteorder == "little"

"""Bit-sliced Hamming comparison.

Fingerprints that share a bucket are laid out vertically: for every block of 64
of them, bit plane p is one 64-bit word that holds bit p of each.  A query is
compared with a whole block at once: its bit, spread over a word, is XORed to the
plane, and the differences go into 64 distances at a time, held as bitwise
counters with a carry-save adder.  A block whose 64 distances all exceed the
radius is abandoned; the blocks that remain move together.
"""

from __future__ import annotations

import numpy as np

#: (query, block) pairs that are updated together: their counters stay in the CPU's caches.
LANES = 1 << 14
#: Planes between two looks for blocks to abandon.
STEP = 8


def planes_of(prints: np.ndarray, block_of: np.ndarray, place: np.ndarray, n_blocks: int) -> np.ndarray:
    """[bits, n_blocks] words; fingerprint i is bit place[i] of block block_of[i]."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")  # a row for each print
    slots = np.zeros((n_blocks, 64, bits.shape[1]), dtype=np.uint8)
    slots[block_of, place] = bits
    packed = np.packbits(slots.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(bits.shape[1], n_blocks)


def _within(planes: np.ndarray, queries: np.ndarray, lane_query: np.ndarray, lane_block: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, words): bit i of a lane's word is set if its query is within the radius of the block's i-th print."""
    n_bits = planes.shape[0]
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # counters start here, so that a carry out of the top means: over the radius
    alive = np.arange(len(lane_query))
    counters = [np.full(len(alive), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> i & 1 else np.uint64(0)) for i in range(width)]
    over = ~valid.copy()
    spread = queries.view(np.uint64)
    for p0 in range(0, n_bits, STEP):
        for p in range(p0, min(p0 + STEP, n_bits)):
            bit = (spread[lane_query, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)
            carry = planes[p, lane_block] ^ (np.uint64(0) - bit)
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
        keep = np.flatnonzero(~over)
        if len(keep) < 0.7 * len(over):
            alive, lane_query, lane_block, over = alive[keep], lane_query[keep], lane_block[keep], over[keep]
            counters = [c[keep] for c in counters]
            if not len(keep):
                break
    return alive, ~over


def close_pairs(bucket: np.ndarray, prints: np.ndarray, radius: int, tree: np.ndarray | None = None):
    """Yield arrays (i, j), i < j, of all rows of the same bucket within the radius.

    bucket: sorted integers; prints: [rows, words] of 64-bit words.  tree, which
    the caller may change between two yields, names each row's tree: a query isn't
    compared with blocks all of whose rows are in its own tree.
    """
    n = len(bucket)
    if n < 2:
        return
    prints = np.ascontiguousarray(prints)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[first, n])
    in_bucket = np.repeat(np.arange(len(first)), sizes)
    rank = np.arange(n) - first[in_bucket]
    blocks = (sizes + 63) // 64
    base = np.r_[0, np.cumsum(blocks)]
    block_of = base[in_bucket] + rank // 64
    # block -> its first row, and the bits that hold a row
    n_blocks = int(base[-1])
    block_bucket = np.repeat(np.arange(len(first)), blocks)
    block_row = first[block_bucket] + 64 * (np.arange(n_blocks) - base[block_bucket])
    filled = np.minimum(64, first[block_bucket] + sizes[block_bucket] - block_row)
    full = np.where(filled == 64, ~np.uint64(0), (np.uint64(1) << filled.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    # a row is compared with its own block (later rows of it) and those after it
    todo = base[in_bucket + 1] - block_of
    todo[sizes[in_bucket] < 2] = 0
    ends = np.cumsum(todo)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + LANES, side="right")))
        # a row with more blocks than fit goes alone, in pieces
        count = todo[row:stop]
        total = int(count.sum())
        if total:
            query = np.repeat(np.arange(row, stop), count)
            blk = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block_of[row:stop], count)
            if tree is not None:
                lo, hi = int(blk.min()), int(blk.max()) + 1
                part = tree[block_row[lo] : block_row[hi - 1] + filled[hi - 1]]
                at = block_row[lo:hi] - block_row[lo]
                low, high = np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)
                open_ = (low[blk - lo] != tree[query]) | (high[blk - lo] != tree[query])
                query, blk = query[open_], blk[open_]
        if total and len(query):
            lo, hi = int(blk.min()), int(blk.max()) + 1
            planes = _planes_between(prints, block_row, filled, lo, hi)
            own = blk == block_of[query]
            later = np.where(rank[query] % 64 == 63, np.uint64(0), ~np.uint64(0) << ((rank[query].astype(np.uint64) + np.uint64(1)) % np.uint64(64)))
            valid = full[blk] & np.where(own, later, ~np.uint64(0))
            lanes, words = _within(planes, prints, query, blk - lo, valid, radius)
            # few lanes at a time: each may have 64 hits
            for s in range(0, len(lanes), 1 << 12):
                hit = np.unpackbits(words[s : s + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                lane, place = np.nonzero(hit)
                if len(lane):
                    lane = lanes[s : s + (1 << 12)][lane]
                    yield query[lane], block_row[blk[lane]] + place
        row = stop


def _planes_between(prints: np.ndarray, block_row: np.ndarray, filled: np.ndarray, lo: int, hi: int) -> np.ndarray:
    sizes = filled[lo:hi]
    start = int(block_row[lo])
    end = int(block_row[hi - 1] + filled[hi - 1])
    block = np.repeat(np.arange(hi - lo), sizes)
    place = np.arange(end - start) - np.repeat(block_row[lo:hi] - start, sizes)
    return planes_of(prints[start:end], block, place, hi - lo)


class Forest:
    """Trees over row numbers: ``tree`` names each row's tree by its smallest row."""

    def __init__(self, n: int) -> None:
        self.tree = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray, agree=None) -> tuple[np.ndarray, np.ndarray]:
        """Join trees by the pairs (i, j); the pairs that did so.

        In each turn every tree is tied to a smaller one by the first pair that
        allows it, so pairs inside one tree cost an array comparison.  agree(i, j),
        if given, tells for arrays of pairs which are links at all; it is asked only
        for pairs that would join two trees, once for each.
        """
        used_i, used_j = [], []
        while True:
            a, b = self.tree[i], self.tree[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, at = np.unique(high, return_index=True)
            tried, high, low = at, high[at], low[at]
            if agree is not None:
                ok = agree(i[at], j[at])
                at, high, low = at[ok], high[ok], low[ok]
            used_i.append(i[at])
            used_j.append(j[at])
            up = np.arange(len(self.tree))
            up[high] = low  # always to a smaller row: no cycle
            while True:
                further = up[up]
                if np.array_equal(further, up):
                    break
                up = further
            self.tree[:] = up[self.tree]
            i, j = np.delete(i, tried), np.delete(j, tried)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *used_i]), np.concatenate([none, *used_j])

"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A stream is cut into blocks of `BLOCK` values (the last may be shorter). A block is a run of 64-bit words; the
top four bits of a word are its selector, which says how many values of how many bits the other 60 bits hold.
Selector 0 is the escape: the whole next word is one value of up to 64 bits. Blocks are independent, so that the
per-block word offsets allow any block to be decoded alone, or all of them at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
# Fixed values of the format: values per word and bits per value, by selector 2 to 15.
COUNTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)
_SMALL = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values]
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): all words, and per block the index of its first word, then the number of words."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks, row = -(-n // BLOCK), BLOCK + 60
    # one row per block; the zeros behind each let a word reach past the block's end
    padded = np.zeros((blocks, row), np.uint64)
    full = n // BLOCK
    padded[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    padded[full:, : n - full * BLOCK] = values[full * BLOCK :]
    flat = padded.reshape(-1)
    bits = widths(flat)
    block = np.arange(blocks)
    pos = block * row
    end = pos + BLOCK
    end[-1] = pos[-1] + n - BLOCK * (blocks - 1)
    taken, steps = np.zeros(blocks, np.int64), []
    while len(pos):  # every block takes, step by step, the selector that packs most values
        sel = np.full(len(pos), 15)
        most = bits[pos]
        sel[most > 60] = 0
        live, have = np.flatnonzero(most <= 30), 1
        most, at = most[live], pos[live]
        for s in range(14, 1, -1):  # a longer word needs narrower values, so who fails here fails on
            for j in range(have, COUNTS[s]):
                most = np.maximum(most, bits[at + j])
            have = int(COUNTS[s])
            fits = np.flatnonzero(most <= WIDTHS[s])
            if not len(fits):
                break
            live, most, at = live[fits], most[fits], at[fits]
            sel[live] = s
        steps.append((block, pos, sel, taken[block]))
        taken[block] += 1 + (sel == 0)
        pos = pos + np.maximum(COUNTS[sel], 1)
        go = np.flatnonzero(pos < end)
        block, pos, end = block[go], pos[go], end[go]
    offsets = np.concatenate([[0], np.cumsum(taken)])
    words = np.zeros(offsets[-1], dtype=np.uint64)
    block, pos, sel, index = (np.concatenate(x) for x in zip(*steps, strict=True))
    to = offsets[block] + index
    for s in np.unique(sel):
        i = np.flatnonzero(sel == s)
        p = pos[i]
        if s == 0:
            words[to[i] + 1] = flat[p]
            continue
        word = np.full(len(i), np.uint64(int(s) << 60))
        for j in range(COUNTS[s]):
            word |= flat[p + j] << np.uint64(j * int(WIDTHS[s]))
        words[to[i]] = word
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of the blocks that offsets delimits; all blocks but the last hold BLOCK values."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    for k in np.flatnonzero(sel == 0):  # a word after an escape is no word of its own; escapes are rare
        if sel[k] == 0 and k + 1 < len(sel):
            sel[k + 1] = 1
    counts = COUNTS[sel]
    counts[sel == 0] = 1
    # the last word of a block may be filled up: its count is what the block still lacks
    sizes = np.full(len(offsets) - 1, BLOCK)
    sizes[-1] = n - BLOCK * (len(sizes) - 1)
    total = np.add.reduceat(counts, offsets[:-1])
    last = offsets[1:] - 1
    last = last - (sel[last] == 1)
    counts[last] -= total - sizes
    to = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for s in np.unique(sel):
        i = np.flatnonzero(sel == s)
        if s == 1:
            continue
        if s == 0:
            out[to[i]] = words[i + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            have = i[counts[i] > j]
            out[to[have] + j] = (words[have] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out

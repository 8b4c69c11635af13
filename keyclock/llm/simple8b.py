"""Simple-8b: whole numbers packed in 64-bit words. The top four bits (the selector) say how many share the other 60.

Numbers are coded in blocks of ``BLOCK``; every block begins a new word and its first word is listed, so that blocks can be packed and
unpacked side by side. A number of more than 60 bits is an escape: selector 0, whose 60 bits are its place in a list of exceptions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: numbers per word for selectors 2 to 15; each takes 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
_POWERS = np.uint64(1) << np.arange(61, dtype=np.uint64)


def _best(widths: np.ndarray) -> np.ndarray:
    """For each position of each row the largest count whose numbers from there on, inside the row, fit in a word."""
    rows, length = widths.shape
    best = np.ones((rows, length), dtype=np.int16)
    powers = {1: widths}
    for n, bits in zip(COUNTS[::-1].tolist(), BITS[::-1].tolist()):
        if n == 1 or n > length:
            continue
        p = 1 << (n.bit_length() - 1)
        while max(powers) < p:
            k = max(powers)
            powers[2 * k] = np.maximum(powers[k][:, : length - 2 * k + 1], powers[k][:, k : length - k + 1])
        m = powers[p]
        fits = np.maximum(m[:, : length - n + 1], m[:, n - p : n - p + length - n + 1]) <= bits
        if not fits.any():
            break
        best[:, : length - n + 1][fits] = n
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and exceptions, all unsigned."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    widths = np.maximum(np.searchsorted(_POWERS, values, side="right"), 1).astype(np.uint8)  # 61: an escape
    blocks = -(-n // BLOCK)
    length = min(BLOCK, n)
    padded = np.full(blocks * length, 62, dtype=np.uint8)  # padding fits nowhere
    padded[:n] = widths
    best = _best(padded.reshape(blocks, length)).ravel()
    starts = np.zeros(blocks * length, dtype=bool)
    at, end = np.arange(blocks) * length, np.minimum((np.arange(blocks) + 1) * length, n)
    while len(at):  # all blocks take their next word at once
        starts[at] = True
        at = at + best[at]
        open_ = at < end
        at, end = at[open_], end[open_]
    first = np.flatnonzero(starts)
    counts = best[first]
    words = np.zeros(len(first), dtype=np.uint64)
    for selector, (count, bits) in enumerate(zip(COUNTS.tolist(), BITS.tolist()), start=2):
        mine = np.flatnonzero(counts == count)
        if len(mine):
            parts = values[first[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[mine] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector << 60)
    escaped = np.flatnonzero(widths[first] == 61)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(first, np.arange(blocks) * length).astype(np.uint32)
    return words, offsets, values[first[escaped]]


def unpack(words: np.ndarray, exceptions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of whole blocks, in order. Every block is decoded from its offset; offsets that do not fit the words are an error."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(selectors == 0, 1, COUNTS[np.maximum(selectors - 2, 0)])
    first = offsets.astype(np.int64)
    if not len(first) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(words):
        raise ValueError("block offsets do not fit the words")
    held = np.add.reduceat(counts, first)
    if (held[:-1] != BLOCK).any() or held[-1] > BLOCK:
        raise ValueError("block offsets do not fit the words")
    # where a word's numbers go: its block's place, and what stands before it in the block
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    upto = np.cumsum(counts) - counts
    begins = block * BLOCK + upto - upto[first][block]
    out = np.zeros((len(first) - 1) * BLOCK + int(held[-1]), dtype=np.uint64)
    for selector, (count, bits) in enumerate(zip(COUNTS.tolist(), BITS.tolist()), start=2):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            shifted = words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[begins[mine][:, None] + np.arange(count)] = shifted & np.uint64((1 << bits) - 1)
    escaped = np.flatnonzero(selectors == 0)
    out[begins[escaped]] = exceptions[words[escaped].astype(np.int64)]
    return out

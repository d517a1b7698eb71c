"""Patched frame of reference: blocks of integers as offsets from their least, packed at a width that most of them fit."""

from __future__ import annotations

import numpy as np

#: Integers of a block; a multiple of the 32 that are packed together.
BLOCK = 1024
#: Share of a block's integers that its width holds at least; the rest are exceptions.
FITS = 0.95
LANE = 32


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def pack_blocks(values: np.ndarray, fits: float = FITS) -> list[bytes]:
    """The blocks of unsigned 32-bit ``values``, each a whole number of 32-bit words.

    A block holds its least value, then width, and number of exceptions in one word, then the low bits of all
    offsets, 32 of them in as many words as the width, then the places of the exceptions in 16 bits each and their high
    bits in 32. The last block is filled with its least value.
    """
    values = np.asarray(values, np.uint32)
    if not len(values):
        return []
    n = -(-len(values) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(values)] = values
    full[len(values) :] = values[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    offsets = full - least[:, None]
    rank = min(BLOCK - 1, int(np.ceil(fits * BLOCK)))
    widths = _bit_lengths(np.partition(offsets, rank, axis=1)[:, rank])
    high = (offsets.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        lanes = (offsets[rows] & np.uint32((1 << width) - 1)).reshape(len(rows), BLOCK // LANE, LANE)
        words = np.zeros((len(rows), BLOCK // LANE, width), np.uint32)
        for k in range(LANE if width else 0):
            word, shift = divmod(k * width, 32)
            words[..., word] |= lanes[..., k] << np.uint32(shift)
            if shift + width > 32:
                words[..., word + 1] |= lanes[..., k] >> np.uint32(32 - shift)
        for row, packed in zip(rows.tolist(), words):
            places = np.flatnonzero(high[row])
            head = np.array([least[row], width | len(places) << 8], "<u4").tobytes()
            pad = b"\0\0" * (len(places) % 2)
            out[row] = head + packed.astype("<u4").tobytes() + places.astype("<u2").tobytes() + pad + high[row, places].astype("<u4").tobytes()
    return out


def unpack_blocks(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All integers of the blocks that start at the word places ``starts`` of a ``<u4`` buffer."""
    starts = np.asarray(starts, np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    widths, exceptions = (words[starts + 1] & 0xFF).astype(np.int64), (words[starts + 1] >> 8).astype(np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        packed = words[starts[rows, None] + 2 + np.arange(width * BLOCK // LANE)].reshape(len(rows), BLOCK // LANE, width)
        lanes = np.zeros((len(rows), BLOCK // LANE, LANE), np.uint32)
        for k in range(LANE if width else 0):
            word, shift = divmod(k * width, 32)
            lanes[..., k] = packed[..., word] >> np.uint32(shift)
            if shift + width > 32:
                lanes[..., k] |= packed[..., word + 1] << np.uint32(32 - shift)
        out[rows] = lanes.reshape(len(rows), BLOCK) & np.uint32((1 << width) - 1)
    for row in np.flatnonzero(exceptions).tolist():
        n, width = int(exceptions[row]), int(widths[row])
        at = int(starts[row]) + 2 + width * BLOCK // LANE
        places = words[at : at + (n + 1) // 2].view("<u2")[:n]
        out[row, places] |= (words[at + (n + 1) // 2 : at + (n + 1) // 2 + n].astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    out += words[starts][:, None]
    return out.reshape(-1)


def pack(values: np.ndarray) -> bytes:
    """A self-contained array: the number of integers and of blocks, the ends of the blocks in words, the blocks."""
    blocks = pack_blocks(values)
    ends = np.cumsum([len(b) // 4 for b in blocks], dtype=np.int64).astype("<u4")
    return np.array([len(values), len(blocks)], "<u4").tobytes() + ends.tobytes() + b"".join(blocks)


def unpack(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, "<u4")
    n, blocks = int(words[0]), int(words[1])
    starts = np.concatenate([[0], words[2 : 2 + blocks].astype(np.int64)])[:blocks]
    return unpack_blocks(words[2 + blocks :], starts)[:n]

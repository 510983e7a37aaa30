"""Static range asymmetric numeral system over token ids: one frequency table, many independent blocks.

A block is coded by ``lanes`` interleaved states (token i belongs to lane i mod lanes), so numpy codes a row of
lanes at a time.  Every ``CHECKPOINT_ROWS`` rows the block keeps all states and the place in its words, from
which a decoder can start; checksums cover the payload and the decoded ids.

Block (little-endian): magic, tokens u32, lanes u32, checkpoints u32, words u32, crc32 of the ids as u32, crc32
of what follows; then for each checkpoint its word position u32 and states u64 x lanes; then the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VRB1"
HEADER = struct.Struct("<4s6I")
MOST_LANES = 512
CHECKPOINT_ROWS = 128
LEAST_STATE = np.uint64(1 << 31)
SCALE_BITS = 20


class Table:
    """Frequencies that sum to 2**bits, at least 1 for each symbol that occurs."""

    def __init__(self, symbols: np.ndarray, frequency: np.ndarray):
        self.symbols, self.frequency = symbols.astype(np.uint32), frequency.astype(np.uint64)
        total = int(self.frequency.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits:
            raise ValueError("frequencies must sum to a power of two")
        self.below = (np.cumsum(self.frequency) - self.frequency).astype(np.uint64)
        self.rank = np.full(int(self.symbols.max()) + 1, -1, np.int64)
        self.rank[self.symbols] = np.arange(len(self.symbols))
        self.owner = np.repeat(np.arange(len(self.symbols)), self.frequency.astype(np.int64))

    @classmethod
    def fitted(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Scales counts (all positive, by ascending symbol) to a power of two."""
        bits = max(SCALE_BITS, len(symbols).bit_length() + 3)
        share = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
        over = int(share.sum()) - (1 << bits)
        for i in np.argsort(-share, kind="stable"):  # the largest bear what rounding gave away
            if not over:
                break
            step = min(over, int(share[i]) // 2) if over > 0 else over
            share[i] -= step
            over -= step
        return cls(symbols, share)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(MOST_LANES, max(1, n // 64)))
    rows = -(-n // lanes)
    rank = table.rank[ids]
    if n and rank.min() < 0:
        raise ValueError("a token is not in the table")
    padded = np.full(rows * lanes, int(np.argmax(table.frequency)) if len(table.frequency) else 0)
    padded[:n] = rank
    padded = padded.reshape(rows, lanes)
    state = np.full(lanes, LEAST_STATE)
    bits, word = np.uint64(table.bits), np.uint64(32)
    limit_shift = np.uint64(63 - table.bits)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for r in range(rows - 1, -1, -1):
        f, below = table.frequency[padded[r]], table.below[padded[r]]
        full = np.flatnonzero(state >= (f << limit_shift))
        if len(full):
            words.append((state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(full)
            state[full] >>= word
        q = state // f
        state = (q << bits) + (state - q * f) + below
        if r % CHECKPOINT_ROWS == 0:
            marks.append((written, state.copy()))
    words.reverse()
    marks.reverse()
    body = b"".join(struct.pack("<I", written - at) + s.astype("<u8").tobytes() for at, s in marks)
    body += b"".join(w.astype("<u4").tobytes() for w in words)
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    return HEADER.pack(MAGIC, n, lanes, len(marks), written, crc, zlib.crc32(body)) + body


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The block's ids; with first and last, only those from checkpoint ``first`` up to checkpoint ``last``."""
    magic, n, lanes, marks, n_words, crc, body_crc = HEADER.unpack_from(block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[HEADER.size :]) != body_crc:
        raise ValueError("damaged block")
    rows = -(-n // lanes) if n else 0
    whole = first == 0 and (last is None or last >= marks)
    if not rows:
        return np.zeros(0, np.uint32)
    mark = 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, HEADER.size + marks * mark).astype(np.uint64)
    at = struct.unpack_from("<I", block, HEADER.size + first * mark)[0]
    state = np.frombuffer(block, "<u8", lanes, HEADER.size + first * mark + 4).astype(np.uint64)
    stop = rows if last is None else min(rows, last * CHECKPOINT_ROWS)
    out = np.empty((stop - first * CHECKPOINT_ROWS, lanes), np.int64)
    bits, word = np.uint64(table.bits), np.uint64(32)
    low = np.uint64((1 << table.bits) - 1)
    for i in range(len(out)):
        slot = state & low
        rank = table.owner[slot.astype(np.int64)]
        out[i] = rank
        state = table.frequency[rank] * (state >> bits) + slot - table.below[rank]
        short = np.flatnonzero(state < LEAST_STATE)
        if len(short):
            state[short] = (state[short] << word) | words[at : at + len(short)]
            at += len(short)
    begin = first * CHECKPOINT_ROWS * lanes
    ids = table.symbols[out.reshape(-1)[: max(0, n - begin)]]
    if whole and zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
        raise ValueError("damaged ids")
    return ids

"""Simple-8b: unsigned ids packed into 64-bit words, and the token files that hold them.

The top four bits of a word select how many values of how many bits its other 60
bits hold. Selector 0 is the escape: its 60 bits count the raw 64-bit words that
follow, for values that no selector fits. Blocks are coded apart, and their word
offsets are kept, so that a block is decoded without those before it and all words
of a block at once.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Selector -> (bits of a value, values in a word); 0 is the escape.
SELECTORS = {1: (1, 60), 2: (2, 30), 3: (3, 20), 4: (4, 15), 5: (5, 12), 6: (6, 10), 7: (7, 8), 8: (8, 7), 9: (10, 6), 10: (12, 5), 11: (15, 4), 12: (20, 3), 13: (30, 2), 14: (60, 1)}
_COUNT = np.array([0] + [SELECTORS[s][1] for s in range(1, 15)] + [0], np.int64)
#: Bits of a value -> the largest selector size that is too small for it.
_TOO_NARROW = np.array([max([0, *(b for b, _ in SELECTORS.values() if b < k)]) for k in range(66)], np.int8)
BLOCK = 1 << 14
MAGIC = b"FOLS8B01"
_TAIL = struct.Struct("<QQQQQI4x8s")


def pack_block(values: np.ndarray) -> np.ndarray:
    """Code words of one block, as uint64."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64)
    top = int(v.max())
    width = _TOO_NARROW[np.frexp(v.astype(np.float64))[1]]
    # width is now the largest selector size that does not fit; each selector's reach by a sliding maximum
    best = np.zeros(n, np.int8)
    widest = min((s for s, (bits, _) in SELECTORS.items() if not top >> bits), default=15)
    best[:] = widest % 15  # fits everywhere
    for s in range(min(widest, 15) - 1, 0, -1):
        bits, many = SELECTORS[s]
        wide = width >= bits
        gaps = np.flatnonzero(wide)  # no full window lies between two of them: this size is never used
        if len(gaps) and max(gaps[0], n - 1 - gaps[-1], int(np.diff(gaps).max(initial=1)) - 1) < many:
            continue
        fits = np.concatenate(([0], np.cumsum(wide, dtype=np.int32)))
        end = np.minimum(np.arange(n) + many, n)
        best[fits[end] == fits[:n]] = s
    raw = bool((best == 0).any())
    if raw:  # an escape takes all values up to the next one that fits a selector
        fits = np.flatnonzero(np.append(best, 1) != 0)
        after = fits[np.searchsorted(fits, np.arange(n))]
        follow = np.where(best == 0, after, np.arange(n) + _COUNT[best])
    else:
        follow = np.arange(n) + _COUNT[best]
    # the heads are 0 and what follows; those known give as many more, by steps that double in length
    follow, heads = np.append(np.minimum(follow, n), n), np.zeros(1, np.int64)
    while heads[-1] < n:
        heads = np.concatenate((heads, follow[heads]))
        follow = follow[follow]
    heads = heads[: np.searchsorted(heads, n)]
    used = best[heads]
    words = used.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((v, np.zeros(60, np.uint64)))
    for s in np.unique(used):
        mine = np.flatnonzero(used == s)
        if s == 0:
            words[mine] = np.diff(np.append(heads, n))[mine].astype(np.uint64)
            continue
        bits, many = SELECTORS[int(s)]
        head, made = heads[mine], words[mine]
        for k in range(many):
            made |= padded[head + k] << np.uint64(k * bits)
        words[mine] = made
    if not raw:
        return words
    out, ends = [], np.append(heads[1:], n)
    for k, s in enumerate(used):
        out.append(words[k : k + 1])
        if s == 0:
            out.append(v[heads[k] : ends[k]])
    return np.concatenate(out)


def unpack_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of one block."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selector]
    data = np.ones(len(words), bool)
    if (selector == 0).any():  # raw words follow escapes: walk to tell them from code words
        at = 0
        while at < len(words):
            if selector[at] == 0:
                many = int(words[at])
                data[at + 1 : at + 1 + many] = False
                count[at], count[at + 1 : at + 1 + many] = 0, 1
                at += many
            at += 1
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector[data]):
        if s == 0:
            continue
        if s not in SELECTORS:
            raise ValueError(f"selector {s} is not defined")
        bits, many = SELECTORS[int(s)]
        mine = np.flatnonzero(data & (selector == s))
        field = (words[mine][:, None] >> (np.arange(many, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[start[mine][:, None] + np.arange(many)] = field
    if not data.all():
        mine = np.flatnonzero(~data)
        out[start[mine]] = words[mine]
    if len(out) < n:
        raise ValueError(f"a block of {n} values has {len(out)}")
    return out[:n]


class TokenFileWriter:
    """Collects documents; ``finish`` gives the file: code words of all blocks, then
    the block index, the document table and a tail that says where they are."""

    def __init__(self):
        self.words, self.at, self.pending, self.held = io.BytesIO(), 0, [], 0
        self.blocks: list[tuple[int, int]] = []
        self.ids, self.has_id, self.counts = [], [], []
        self.n_values = 0

    def add(self, doc_id: int | None, values: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.has_id.append(doc_id is not None)
        self.counts.append(len(values))
        self.n_values += len(values)
        self.pending.append(values)
        self.held += len(values)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        v = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint64)
        whole = len(v) if last else len(v) // BLOCK * BLOCK
        for lo in range(0, whole, BLOCK):
            words = pack_block(v[lo : min(lo + BLOCK, whole)])
            self.blocks.append((self.at, min(BLOCK, whole - lo)))
            self.words.write(words.astype("<u8").tobytes())
            self.at += len(words)
        self.pending, self.held = [v[whole:]], len(v) - whole

    def finish(self) -> bytes:
        self._flush(True)
        words = self.words.getvalue()
        index = np.array(self.blocks, "<u8").reshape(-1, 2).tobytes()
        table = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.has_id, "u1").tobytes()
        tail = _TAIL.pack(len(words), len(self.blocks), len(self.ids), self.n_values, BLOCK, zlib.crc32(table, zlib.crc32(index)), MAGIC)
        return b"".join((MAGIC, words, index, table, tail))


class TokenFile:
    """Reads a token file from a seekable stream, block by block."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _TAIL.size)
        n_words, n_blocks, n_docs, self.n_values, self.block, crc, magic = _TAIL.unpack(stream.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        stream.seek(len(MAGIC) + n_words)
        index, table = stream.read(16 * n_blocks), stream.read(17 * n_docs)
        if zlib.crc32(table, zlib.crc32(index)) != crc:
            raise ValueError("the index of a token file is damaged")
        self.n_words = n_words // 8
        self.blocks = np.frombuffer(index, "<u8").reshape(-1, 2).astype(np.int64)
        self.ids = np.frombuffer(table, "<i8", n_docs)
        self.counts = np.frombuffer(table, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.has_id = np.frombuffer(table, "u1", n_docs, 16 * n_docs).astype(bool)

    def read_block(self, k: int) -> np.ndarray:
        lo = int(self.blocks[k, 0])
        hi = int(self.blocks[k + 1, 0]) if k + 1 < len(self.blocks) else self.n_words
        self.stream.seek(len(MAGIC) + 8 * lo)
        return unpack_block(np.frombuffer(self.stream.read(8 * (hi - lo)), "<u8"), int(self.blocks[k, 1]))

    def values(self, start: int, count: int) -> np.ndarray:
        """Any range of values, through the blocks that hold it."""
        if not count:
            return np.empty(0, np.uint64)
        first, last = start // self.block, (start + count - 1) // self.block
        v = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return v[start - first * self.block :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document: id, its start in the file, its values; one block is held at a time."""
        held, k, at = np.empty(0, np.uint64), 0, 0
        for doc, known, n in zip(self.ids.tolist(), self.has_id.tolist(), self.counts.tolist(), strict=True):
            parts, need = [], n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held, k = self.read_block(k), k + 1
            parts.append(held[:need])
            held = held[need:]
            yield (doc if known else None), at, np.concatenate(parts) if len(parts) > 1 else parts[0]
            at += n

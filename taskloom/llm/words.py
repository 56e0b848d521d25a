"""Words of a batch of texts as arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, so word positions never depend on an encoding or on Unicode versions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
# For work that holds many arrays of numbers for each word.
SMALL_CHUNK_BYTES = 1 << 20
LONG_WORD = 128

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([0] + [2 ** (8 * k) - 1 for k in range(1, 9)], dtype=np.uint64)


def text_chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of record batches with at most ``limit`` bytes of text, or one longer text.

    Yields the slice and its texts as bytes; a null text is an empty one. Only a slice's texts are copied, not the batch's.
    """
    for batch in batches:
        data = batch.column(column).cast(pa.binary())
        end = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy())
        start, before = 0, 0
        while start < len(end):
            stop = max(start + 1, int(np.searchsorted(end, before + limit, side="right")))
            size = stop - start
            yield batch.slice(start, size), [t or b"" for t in data.slice(start, size).to_pylist()]
            start, before = stop, int(end[stop - 1])


def unused(frame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in frame.columns:
        name += "_"
    return name


class Words:
    """Byte ranges of the words of some texts, in one buffer.

    ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n" + bytes(8)
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        blank = _SPACE[self.buffer[:-8]]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.joined = joined

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def body(self) -> np.ndarray:
        """The bytes of all words, without what stands between them."""
        text = self.buffer[:-8]
        return text[~_SPACE[text]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.end - self.start
        eight = np.ndarray(
            (len(self.buffer) - 7,), dtype=np.uint64, buffer=self.buffer.data, strides=(1,)
        )
        value = length.astype(np.uint64)
        left = np.flatnonzero(length <= LONG_WORD)
        offset = 0
        while left.size:
            part = eight[self.start[left] + offset]
            part = part & _KEEP[np.minimum(length[left] - offset, 8)]
            value[left] = mix(value[left] ^ part)
            offset += 8
            left = left[length[left] > offset]
        for i in np.flatnonzero(length > LONG_WORD):
            digest = hashlib.blake2b(self.joined[self.start[i] : self.end[i]], digest_size=8)
            value[i] = int.from_bytes(digest.digest(), "little")
        return value


def mix(value: np.ndarray) -> np.ndarray:
    """Spread each bit of a 64-bit value over all of them, one to one."""
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes along the first axis, one for each start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros((n, *words.shape[1:]), dtype=np.uint64)
    for k in range(size):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += words[k : k + n]
    return mix(value)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which starts of windows over all words stay within one text."""
    total = int(first[-1])
    n = max(0, total - size + 1)
    ok = np.ones(n, dtype=bool)
    for border in first[1:-1]:
        ok[max(0, border - size + 1) : border] = False
    return ok

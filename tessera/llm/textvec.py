"""Vectorised text primitives for Arrow batches.

A batch of texts is one byte array plus offsets.  Word boundaries, word
hashes and shingle hashes of all texts in a slice come from a few numpy
passes over those bytes; there is no per-word Python.

Words are ``[^\\x20\\x09-\\x0D]+``.  Those separators are ASCII, so they never
occur inside a multi-byte UTF-8 character and bytes can be scanned directly.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: What of a block of 8 bytes belongs to a span of which 0 to 8 bytes are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the published splitmix64 steps)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and its n + 1 offsets; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row runs of about ``limit`` text bytes: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer; past the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _keyed(block: np.ndarray, position: np.ndarray | int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(block ^ mix(np.atleast_1d(np.asarray(position, _U)) + _U(seed)))


def span_hash(block: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, from the ``blocks`` of their bytes.

    Each block of 8 bytes is mixed with its position in the span and the seed before
    the sum is taken, so nothing is linear in the bytes: texts made to collide
    under a polynomial do not collide here.  Who knows the seed can still solve
    the sum for a block, since mixing can be undone; whoever compares texts that
    others wrote takes a seed that they cannot know (``secret_key``).  Under it
    two spans are equal by chance alone, about once in 2**64 comparisons.
    """
    size = end - start
    total = _keyed(block[start] & _LEFT[np.minimum(size, 8)], 0, seed)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        at = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        left = np.repeat(size[long], more) - 8 * at
        with np.errstate(over="ignore"):
            total[long] += np.add.reduceat(_keyed(block[np.repeat(start[long], more) + 8 * at] & _LEFT[np.minimum(left, 8)], at, seed), first)
    with np.errstate(over="ignore"):
        return mix(total + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def secret_key() -> int:
    """A key for one job, drawn on the driver and carried to all its tasks.

    Hashes under different keys must not meet; those of a model that is kept, or
    must come out alike each time, are taken without a key.
    """
    return secrets.randbits(63) | 1


class Words:
    """Words of all texts of a slice: byte spans, 64-bit hashes (under ``key``), and per-text offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, key: int = 0):
        self._seed = 1 + key
        self.n_texts = len(offsets) - 1
        if len(data) == 0:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            word = ~_SPACE[data]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            filled = np.flatnonzero(offsets[1:] > offsets[:-1])
            begin, stop = offsets[:-1][filled], offsets[1:][filled] - 1
            first[begin] = word[begin]
            last[stop] = word[stop]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Word number at which each text begins, and the total.
        self.offsets = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.offsets)
        self._data = _LOWER[data] if lower else data
        self._blocks = blocks(self._data)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans; equal spans have equal hashes."""
        return span_hash(self._blocks, start, end, self._seed)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """The words of all texts with one byte 32 after each, and the byte offsets of the texts."""
        size = self.end - self.start + 1
        last = np.cumsum(size)
        at = np.repeat(self.start - (last - size), size) + np.arange(int(last[-1]) if len(last) else 0)
        line = self._data[np.minimum(at, max(len(self._data) - 1, 0))]
        line[last - 1] = 32
        return line.tobytes(), np.concatenate([[0], last])[self.offsets]

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.n_texts), self.count)

    def shingles(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word windows, in order, and per-text offsets.

        A window's is a sum over its words' hashes, which nobody can solve for a
        word without the key that made them.
        With ``short``, a text of 1 to k - 1 words has its whole sequence as
        its one window; else such texts have none.
        """
        n = len(self.hash)
        per = np.maximum(self.count - k + 1, 0)
        whole = (self.count > 0) & (self.count < k) if short else np.zeros(self.n_texts, bool)
        out_off = np.concatenate([[0], np.cumsum(per + whole)])
        out = np.zeros(int(out_off[-1]), _U)
        with np.errstate(over="ignore"):
            if n >= k:
                acc = np.zeros(n - k + 1, _U)
                for j in range(k):
                    acc += self.hash[j : n - k + 1 + j] * _U(_MULT[j])
                inside = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.offsets[:-1], per)
                at = np.arange(len(inside)) + np.repeat(out_off[:-1] - (np.cumsum(per) - per), per)
                out[at] = mix(acc[inside])
            for t in np.flatnonzero(whole):
                h = _U(int(self.count[t]) * 0xA0761D6478BD642F % (1 << 64))
                for j, w in enumerate(self.hash[self.offsets[t] : self.offsets[t + 1]]):
                    h = h + w * _U(_MULT[j])
                out[out_off[t]] = mix(np.array([h], _U))[0]
        return out, out_off


_MULT = [(0xC2B2AE3D27D4EB4F * (2 * j + 1) + 0x165667B19E3779F9 * j * (j + 1)) % (1 << 64) | 1 for j in range(64)]


def text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets (empty runs: 0)."""
    total = np.concatenate([np.zeros(1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else values.dtype), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's signed 64-bit integers, bit for bit."""
    return x.view(np.int64)

"""Vectorised text kernels over Arrow string columns.

A batch's texts lie in one UTF-8 buffer. The kernels work on that buffer in
chunks of whole documents, so that the memory they take is bounded by the
chunk size (or the longest document), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of lanes and of their places.
LANE, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, UTF-8 bytes, offsets of documents in them); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross documents: starts, ends, documents."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes (little-endian) from each byte on; behind the end they are zero."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def masked(lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each lane's first ``sizes`` bytes (none for sizes below 1, all from 8 on), the others zero."""
    left = np.clip(sizes, 0, 8).astype(np.uint64)
    shift = np.minimum(np.uint64(64) - (left << np.uint64(3)), np.uint64(63))
    return np.where(left > 0, lanes & (np.uint64(2**64 - 1) >> shift), np.uint64(0))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes.

    Each lane of eight bytes is mixed with its place in the span by a bijection that is not linear; a span's hash is the
    mixed sum of these with its length, so spans of one length up to eight bytes never collide. A polynomial modulo 2**64
    would have equal values for whole families of texts.
    """
    size = ends - starts
    count = (size + 7) >> 3
    total = np.cumsum(count)
    if not len(size) or not total[-1]:
        return mix(size.astype(np.uint64) * LANE)
    first = total - count
    k = np.arange(total[-1]) - np.repeat(first, count)
    value = lanes_of(data)[np.repeat(starts, count) + (k << 3)]
    some = np.flatnonzero(count)
    last = total[some] - 1
    value[last] = masked(value[last], size[some] - ((count[some] - 1) << 3))
    value = mix((value ^ (k.astype(np.uint64) * PLACE)) * LANE)
    sums = np.zeros(len(size), np.uint64)
    sums[some] = np.add.reduceat(value, first[some])
    return mix(sums + size.astype(np.uint64) * LANE)


def windows_hash(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one document: (hashes, index of the first word)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD1342543DE82EF95)
        h += words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(h[at]), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - at, counts)

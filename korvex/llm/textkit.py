"""Vectorised text kernels over Arrow string buffers: words, word hashes, shingles.

Words are maximal runs of bytes outside space and 0x09-0x0D; those bytes are ASCII, so splitting UTF-8 bytes equals
splitting code points. Batches are cut into slices of about a megabyte, so temporaries stay small; a longer document
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
#: Bytes of the words of a hash that are mixed block by block; longer words go through BLAKE2b.
BLOCKED = 64
_BLOCK_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = [_U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes are space or 0x09-0x0D."""
    return (raw == 0x20) | (raw - np.uint8(9) < 5)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z folded."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64, len(array) + 1, array.offset * 8) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in ``raw``; ``cuts`` are positions at which a word ends in any case."""
    solid = np.empty(len(raw) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(spaces(raw), out=solid[1:-1])
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    starts[inner] = solid[1:-1][inner]
    ends[inner - 1] = solid[1:-1][inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def blocks_view(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """The 8 bytes from each position of ``raw`` on as a little-endian number, zeros after its end; a view, no copies
    of the blocks."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = lowered(raw) if lower else raw
    return np.ndarray(shape=(len(raw) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))


def block_of(blocks: np.ndarray, starts: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k .. 8k + 7 of spans of more than 8k bytes (of any size, if k is 0), zeros behind their ends."""
    return blocks[starts + 8 * k if k else starts] & _BLOCK_MASK[np.minimum(size - 8 * k if k else size, 8)]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes (after folding A-Z if ``lower``).

    Every block of eight bytes goes through a bijection before the next is taken in, so spans of up to eight bytes and
    equal length never collide, and no repetitive text makes others collide by its structure.
    """
    blocks = blocks_view(raw, lower)
    size = ends - starts
    out = mix(block_of(blocks, starts, size, 0) + size.astype(np.uint64) * _STEP[0])
    rest = np.flatnonzero(size > 8)
    for k in range(1, BLOCKED // 8):
        if not len(rest):
            break
        out[rest] = mix(out[rest] ^ (block_of(blocks, starts[rest], size[rest], k) * _STEP[1] + _STEP[2]))
        rest = rest[size[rest] > 8 * (k + 1)]
    if len(rest):
        data = blocks.base
        for i in rest.tolist():
            own = bytes(data[starts[i] : ends[i]])
            out[i] = int.from_bytes(blake2b(own, digest_size=8).digest(), "little")
    return out


def unit_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True, step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each unit); ``bounds`` are the starts of the units in ``raw``. Works on
    about ``step`` bytes at a time, cut where no word is, so a very long text needs little beside its hashes."""
    if len(raw) <= 2 * step:
        starts, ends = word_spans(raw, bounds)
        return span_hashes(raw, starts, ends, lower), np.diff(np.append(np.searchsorted(starts, bounds), len(starts))).astype(np.int64)
    parts, words, a = [], np.zeros(len(bounds), np.int64), 0
    while a < len(raw):
        b = min(len(raw), a + step)
        while b < len(raw):  # on to the next space or unit
            space = np.flatnonzero(spaces(raw[b : b + 4096]))
            stop = b + int(space[0]) if len(space) else min(len(raw), b + 4096)
            unit = int(np.searchsorted(bounds, b))
            if unit < len(bounds) and bounds[unit] <= stop:
                b = int(bounds[unit])
                break
            b = stop
            if len(space):
                break
        part = raw[a:b]
        first, last = np.searchsorted(bounds, [a, b])
        own = bounds[first:last] - a
        starts, ends = word_spans(part, own)
        parts.append(span_hashes(part, starts, ends, lower))
        at = np.concatenate([[0], np.searchsorted(starts, own), [len(starts)]])
        counts = np.diff(at)
        if first:
            words[first - 1] += counts[0]
        words[first:last] += counts[1:]
        a = b
    return np.concatenate(parts), words


def run_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 5-word shingles of each unit, sorted, concatenated, and how many each has.

    ``hashes`` are word hashes in order, ``counts`` the words of each unit. A unit with fewer than five words has
    its whole sequence as its one shingle; one without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    full = np.maximum(counts - (SHINGLE - 1), 0)
    out = np.zeros(int(full.sum() + ((counts > 0) & (full == 0)).sum()), np.uint64)
    made = np.where((counts > 0) & (full == 0), 1, full)
    at = np.cumsum(made) - made
    if len(counts) == 1:  # a long text: a piece at a time
        for a in range(0, int(full[0]), SLICE_BYTES):
            own = hashes[a : min(a + SLICE_BYTES, int(full[0])) + SHINGLE - 1]
            out[a : a + len(own) - SHINGLE + 1] = _rolled(own)
    elif len(hashes) >= SHINGLE:
        out[gather_runs(at, full)] = _rolled(hashes)[gather_runs(begins, full)]
    short = np.flatnonzero((counts > 0) & (full == 0))
    if len(short):
        whole = counts[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            whole[has] += hashes[begins[short[has]] + k] * _STEP[k]
        out[at[short]] = mix(whole)
    several = made > 1
    for a, b in zip(at[several].tolist(), (at + made)[several].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    keep[at[made > 0]] = True
    if keep.all():
        return out, made
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return out[keep], kept[at + made] - kept[at]


def _rolled(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    out = hashes[:n] * _STEP[0]
    for k in range(1, SHINGLE):
        out += hashes[k : n + k] * _STEP[k]
    return mix(out)


def set_prints(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each unit's set (order does not matter; the size is mixed in)."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    for a in range(0, len(tokens), SLICE_BYTES):
        total[a + 1 : a + SLICE_BYTES + 1] = mix(tokens[a : a + SLICE_BYTES] * _STEP[1] + _STEP[2])
    np.cumsum(total, out=total)
    ends = np.cumsum(counts)
    return mix((total[ends] - total[ends - counts]) * _STEP[3] + counts.astype(np.uint64) * _STEP[4])


def doc_shingles(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, tokens, counts) slice by slice: each document's shingle set."""
    raw, offsets = buffers(array)
    for i, j in slices(offsets):
        hashes, words = unit_hashes(raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
        tokens, counts = shingle_sets(hashes, words)
        del hashes
        yield i, j, tokens, counts

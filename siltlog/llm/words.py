"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as spans and 64-bit hashes, on NumPy arrays.

A word's hash depends only on its bytes after A-Z are lower-cased. Scratch memory follows PART, not
the length of a text: long texts are taken in parts that end at a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that are looked at together; a longer word is still taken whole.
PART = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: The first bytes of a lane of eight, by how many of them count.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words above this many bytes are hashed one by one.
_LONG = 64
_RANDOM = np.random.default_rng(20240229)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and where each row starts; null counts as empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most `most` bytes each (one row at least), so that scratch arrays stay small."""
    _, offsets = flat(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each row the number of words before it.

    breaks: for each byte, whether a word ends before it even if no blank stands there.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~BLANK[data]
    first = np.zeros(n + 1, bool)  # a row or the whole ends before here
    first[offsets] = True
    if breaks is not None:
        first[:n] |= breaks
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges of about PART that cut no word, and which rows begin in each (first, end)."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + PART)
        if hi < n:
            row = int(np.searchsorted(offsets, hi, "right"))
            if offsets[row - 1] > lo:
                hi = int(offsets[row - 1])
            else:
                blanks = np.flatnonzero(BLANK[data[lo:hi]])
                end = int(offsets[row])
                while not len(blanks) and hi < end:  # a word that is longer than a part
                    more = np.flatnonzero(BLANK[data[hi : min(end, hi + PART)]])
                    hi, blanks = (hi + int(more[0]), more) if len(more) else (min(end, hi + PART), more)
                    if len(more):
                        break
                else:
                    hi = lo + int(blanks[-1]) + 1 if len(blanks) else hi
        first, end_row = np.searchsorted(offsets, [lo, hi])
        yield lo, hi, int(first), int(end_row)
        lo = hi


def word_hashes(column: pa.Array, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all rows, and for each row the number of words before it."""
    data, offsets = flat(column)
    found, rows, n = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64), 0
    for lo, hi, first, end in parts(data, offsets):
        starts, ends, before = spans(data[lo:hi], offsets[first:end] - lo)
        found.append(hash_spans(data[lo:hi], starts, ends, lower, seed))
        rows[first:end] = n + before
        n += len(starts)
    rows[offsets == len(data)] = n
    return np.concatenate(found), rows


def _lanes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """The eight bytes from each place on, lower-cased if asked, as a number."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[:-8] = LOWER[data] if lower else data
    return np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """Each word's bytes, eight at a time: every eight are mixed with the seed before they join the chain.

    A job that draws its seed anew cannot be given words that were made to collide.
    """
    lanes, sizes, key = _lanes(data, lower), ends - starts, mix(np.array([seed ^ 0x5851F42D4C957F2D], np.uint64))
    out = mix((lanes[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _LENGTH) ^ key)
    more, k = np.flatnonzero(sizes > 8), 8
    while len(more) and k < _LONG:
        lane = lanes[starts[more] + k] & _MASKS[np.minimum(sizes[more] - k, 8)]
        out[more] = mix((out[more] * _STEP) ^ mix(lane + key))
        k += 8
        more = more[sizes[more] > k]
    for w in more.tolist():
        word = data[starts[w] : ends[w]]
        out[w] = xxhash.xxh3_64_intdigest((LOWER[word] if lower else word).tobytes(), seed)
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the same lower-cased bytes as the word whose number `other` gives."""
    lanes, sizes = _lanes(data), ends - starts
    out = sizes == sizes[other]
    more, k = np.flatnonzero(out), 0
    while len(more) and k < _LONG:
        mask = _MASKS[np.minimum(sizes[more] - k, 8)]
        out[more] = ((lanes[starts[more] + k] ^ lanes[starts[other[more]] + k]) & mask) == 0
        k += 8
        more = more[out[more] & (sizes[more] > k)]
    for w in more.tolist():
        o = other[w]
        out[w] = w == o or bool((LOWER[data[starts[w] : ends[w]]] == LOWER[data[starts[o] : ends[o]]]).all())
    return out


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of `values` that begin at `starts`, end to end."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


_WEIGHTS = (_RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` (64 at most) values in a row."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : n + k] * _WEIGHTS[k]
    return mix(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its windows of `size` words.

    A row with fewer words has its whole sequence as one window; a row without words has none.
    """
    windows = window_hashes(hashes, size)
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(windows[lo : hi - size + 1])
        elif hi > lo:
            short = (hashes[lo:hi] * _WEIGHTS[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)

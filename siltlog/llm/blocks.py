"""Blocks of documents whose words are numbered: a corpus as per-block vocabularies and number sequences.

A block is a run of documents of one input partition. Each word stands once in a block's vocabulary
however often it occurs, so a shuffle by word moves no word more than once a block, and no word is
hot. What the shuffle finds out about a word goes back to its number, and the documents of the
block are put together from their sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from siltlog.llm.words import flat, slices

#: Text bytes after which a block ends, and vocabulary entries in a row.
BLOCK_BYTES, ENTRIES = 48_000_000, 20_000


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed by planes: first the low bytes, then the higher ones as far as there are any."""
    width = 8 if len(numbers) and int(numbers.max()) >> 32 else 4
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    used = width - next((k for k in range(width) if planes[width - 1 - k].any()), width - 1) if len(numbers) else 0
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def expand(data: bytes) -> np.ndarray:
    used = data[0]
    if not used:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k in range(used):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def join_bytes(parts: list[bytes]) -> bytes:
    """Byte strings as one, compressed."""
    sizes = squeeze(np.fromiter(map(len, parts), np.int64, len(parts)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=6).compress(b"".join(parts))


def split_bytes(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    sizes = expand(data[4 : 4 + n])
    whole, ends = zstandard.ZstdDecompressor().decompress(data[4 + n :]), np.cumsum(sizes)
    return [whole[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of runs of rows; a run ends once its texts, in the last column, have `limit` bytes or more."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> tuple[pa.Array, ...]:
        return tuple(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pa.Table.from_batches(held).columns)

    for batch in batches:
        for at, texts in slices(batch.column(batch.num_columns - 1)):
            held.append(batch.slice(at, len(texts)))
            size += len(flat(texts)[0])
            if size >= limit:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()

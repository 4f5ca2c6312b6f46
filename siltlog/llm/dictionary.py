"""A dictionary of all words of a corpus: words are numbered within blocks, then once for all blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.blocks import expand, join_bytes, split_bytes, squeeze

#: Text bytes whose words are numbered together, while the numbers of a block go on.
PART = 4_000_000


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts of any length, and for each offset the number of words before it."""
    spans, before, n = [], np.zeros(len(offsets), np.int64), 0
    for lo, hi, first, end in words.parts(data, offsets):
        s, e, rows = words.spans(data[lo:hi], offsets[first:end] - lo)
        spans.append((s + lo, e + lo))
        before[first:end] = n + rows
        n += len(s)
    before[offsets == len(data)] = n
    starts, ends = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*spans) if spans else ((), ())))
    return starts, ends, before


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of a block, and the distinct words by number. Words are told apart by their bytes."""
    known = pa.array([], pa.large_binary())
    found, lo = [np.zeros(0, np.int64)], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PART)))
        # words and the gaps between them, end to end, are encoded as they lie; the gaps' numbers are left
        edges = np.empty(2 * (hi - lo), np.int64)
        edges[0::2], edges[1::2] = starts[lo:hi], ends[lo:hi]
        base = int(edges[0])
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges - base).tobytes()), pa.py_buffer(data[base : edges[-1]])])
        coded = every.dictionary_encode()
        codes = coded.indices.to_numpy()[0::2]
        used, codes = np.unique(codes, return_inverse=True)
        names = coded.dictionary.take(pa.array(used))
        at = pc.index_in(names, value_set=known)
        new = pc.is_null(at)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = new.to_numpy(zero_copy_only=False)
        place[fresh] = len(known) + np.arange(int(fresh.sum()))
        known = pa.concat_arrays([known, names.filter(new)])
        found.append(place[codes])
        lo = hi
    return np.concatenate(found), known


def entry_rows(names: pa.Array, counts: np.ndarray, buckets: int) -> list[tuple]:
    """(bucket, places, names, counts) of a block's entries, dealt by a hash of the name."""
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    of = (words.hash_spans(data, ends[:-1], ends[1:], False) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    used, first = np.unique(of[order], return_index=True)
    held = names.to_pylist()
    return [(int(b), squeeze(np.diff(p, prepend=0)), join_bytes([held[k] for k in p.tolist()]), squeeze(counts[p])) for b, p in zip(used, np.split(order, first[1:]) if len(used) else [], strict=True)]


def numbered(entries: DataFrame, buckets: int, least: int = 1) -> DataFrame:
    """Rows (block, places, ids) for rows (block, bucket, places, names, counts) of entries, and (id, name, count) for each distinct name met `least` times.

    Entries are shuffled by name, once for each block that has them. An id is the rank by count in a
    bucket, times `buckets`, and the bucket, so frequent words have small ids; 0 stands for a rarer
    entry. A task holds a bucket, so `buckets` should grow with the corpus.
    """

    def ids(rows: pa.Table) -> pa.Table:
        held = [split_bytes(b) for b in rows.column("names").to_pylist()]
        coded = pa.array([w for names in held for w in names], pa.binary()).dictionary_encode()
        counts = np.concatenate([np.zeros(0, np.int64), *map(expand, rows.column("counts").to_pylist())])
        which = coded.indices.to_numpy()
        total = np.bincount(which, counts, len(coded.dictionary)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        stay = total >= least
        known = np.where(stay, rank * buckets + rows.column("bucket")[0].as_py(), 0)
        sent = np.split(known[which], np.cumsum([len(names) for names in held])[:-1])
        n, m = rows.num_rows, int(stay.sum())
        columns = [rows.column("block").combine_chunks(), rows.column("places").combine_chunks(), pa.array([squeeze(x) for x in sent], pa.binary())]
        columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in columns]
        fresh = [pa.array(known[stay]), coded.dictionary.filter(pa.array(stay)), pa.array(total[stay])]
        columns += [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in fresh]
        return pa.Table.from_arrays(columns, ["block", "places", "ids", "id", "name", "count"])

    return entries.groupBy("bucket").applyInArrow(ids, "block long, places binary, ids binary, id long, name binary, count long")


def ids_by_number(rows: pa.Table) -> np.ndarray:
    """Ids of a block's entries, from its rows (places, ids)."""
    places = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(expand(b)) for b in rows.column("places").to_pylist())])
    out = np.zeros(len(places), np.int64)
    out[places] = np.concatenate([np.zeros(0, np.int64), *map(expand, rows.column("ids").to_pylist())])
    return out


def bucket_count(df: DataFrame) -> int:
    """Buckets of a shuffle by word: as many as a shuffle has partitions, 256 at least."""
    return max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def known_words(numbered_rows: DataFrame) -> DataFrame:
    """(id, name, count) of the dictionary."""
    return numbered_rows.filter(F.col("id").isNotNull()).select("id", "name", "count")

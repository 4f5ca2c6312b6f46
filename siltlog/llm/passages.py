"""Removal of repeated passages: each document is parsed into factors of all reference blocks of the corpus.

A reference block is a run of documents. Its index holds the anchors of its texts: of the windows of
`window` words that follow one another, those whose smallest inner window of ANCHOR words is the same
one lie around one anchor, and equal windows have equal anchors at equal places. So a document can
only share a window with blocks that have its anchor, and looking its anchors up in the joined index
is parsing it against every block. Where all occurrences of an anchor have the same surroundings, the
factor goes on over all windows around it; where surroundings differ, a factor ends there for some of
them, and the windows around this boundary are compared one by one. Factors that touch are one span.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.blocks import expand, squeeze, text_blocks
from siltlog.llm.dictionary import spans_of
from siltlog.llm.shared import stored

#: Words of an anchor; a window holds at least this many.
ANCHOR = 12
#: Text bytes of a reference block.
BLOCK_BYTES = 16_000_000
#: Words that are parsed together.
STRETCH = 1 << 20
#: What the joined index says of an anchor.
ALONE, REPEATED, CONTESTED = 0, 1, 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each `width` values in a row, the place of the first smallest."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at, span = np.where(values[b] < values[a], b, a), span + step
    return at


def runs(hashes: np.ndarray, rows: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of each stretch by anchor: (first, length, anchor hash, hash of the surroundings) of each run, and (first window, window hashes).

    A run is cut where a stretch ends, which makes its surroundings look different and is settled window by window.
    """
    size = min(ANCHOR, window)
    for lo in range(0, max(0, len(hashes) - window + 1), STRETCH):
        some = hashes[lo : lo + STRETCH + window - 1]
        n = len(some) - window + 1
        inner, whole = words.window_hashes(some, size), words.window_hashes(some, window)
        anchor = _least(inner, window - size + 1)[:n]
        ends = rows[np.searchsorted(rows, np.arange(lo, lo + n), "right")]  # the end of the text that a window begins in
        held = np.arange(lo, lo + n) + window <= ends
        first = held.copy()
        first[1:] &= ~held[:-1] | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(first)
        last = held.copy()
        last[:-1] &= ~held[1:] | first[1:]
        lengths = np.flatnonzero(last) + 1 - starts
        a = anchor[starts]
        place = (((a - starts) << 8) + lengths).astype(np.uint64)
        around = words.mix(words.mix(whole[starts]) + whole[starts + lengths - 1] * np.uint64(0x9E3779B97F4A7C15) + words.mix(place))
        yield lo + starts, lengths, inner[a], around, lo, whole


def _anchors(texts: pa.Array, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of a block: first windows, lengths, anchor hashes, surroundings; and the words before each text."""
    hashes, rows = words.word_hashes(texts, False, seed)
    found = [r[:4] for r in runs(hashes, rows, window)]
    empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    return (*(np.concatenate([e, *c]) for e, c in zip(empty, zip(*found) if found else [[]] * 4, strict=True)), rows)


def _parts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Slices of sorted hashes by bucket; a bucket is a range of hashes."""
    if not len(keys):
        return []
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    used, first = np.unique(of, return_index=True)
    return [(int(b), slice(lo, hi)) for b, lo, hi in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]


BLOCKS = "block long, ids array<{id}>, sizes binary, texts binary, bucket int, anchors binary, around binary, several binary"


def _indexed(batches: Iterable[pa.RecordBatch], window: int, buckets: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for the texts of a block, and one for its anchors in each bucket."""
    names = ["block", "ids", "sizes", "texts", "bucket", "anchors", "around", "several"]
    base = TaskContext.get().partitionId() << 24
    for k, (ids, texts) in enumerate(text_blocks(batches, BLOCK_BYTES)):
        data, offsets = words.flat(texts)
        _, _, anchor, around, _ = _anchors(texts, window, seed)
        keys, first, which, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
        differ = np.bincount(which, around[first][which] != around, len(keys)) > 0
        kind = np.where(differ, CONTESTED, np.where(counts > 1, REPEATED, ALONE)).astype(np.uint8)
        parts = _parts(keys, buckets)
        n = len(parts)
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * n, pa.int32()), ids)
        held = pa.concat_arrays([held.slice(0, 1), pa.nulls(n, held.type)])
        row = [[squeeze(np.diff(offsets))] + [None] * n, [zstandard.ZstdCompressor(level=3).compress(data.tobytes())] + [None] * n]
        index = [[None, *([x[p].tobytes() for _, p in parts])] for x in (keys, around[first], kind)]
        yield pa.RecordBatch.from_arrays([pa.array([base + k] * (n + 1)), held, *[pa.array(c, pa.binary()) for c in row], pa.array([None, *(b for b, _ in parts)], pa.int32()), *[pa.array(c, pa.binary()) for c in index]], names)


def _looked_up(rows: pa.Table) -> pa.Table:
    """What the blocks of a bucket know of its anchors together, sent back to each of them."""
    keys, around, kind = (np.concatenate([np.frombuffer(b, t) for b in rows.column(c).to_pylist()]) for c, t in (("anchors", np.uint64), ("around", np.uint64), ("several", np.uint8)))
    names, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    differ = np.bincount(which, (around[first][which] != around) | (kind == CONTESTED), len(names)) > 0
    twice = (counts > 1) | (np.bincount(which, kind, len(names)) > 0)
    said = np.where(differ, CONTESTED, np.where(twice, REPEATED, ALONE)).astype(np.uint8)[which]
    ends = np.cumsum([len(b) for b in rows.column("several").to_pylist()])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "said": pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(said, ends[:-1])], pa.binary())})


def _joined(rows: pa.Table, column: str) -> np.ndarray:
    """What the buckets say, in their order, which is that of the block's sorted hashes."""
    rows = rows.filter(pc.is_valid(rows.column(column))).sort_by("bucket")
    return np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for b in rows.column(column).to_pylist()), np.uint8)


def _texts(blocks: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a block as they were stored."""
    row = blocks.filter(pc.is_valid(blocks.column("texts")))
    sizes, data = expand(row.column("sizes")[0].as_py()), zstandard.ZstdDecompressor().decompress(row.column("texts")[0].as_py())
    ends = np.concatenate([[0], np.cumsum(sizes)])
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data))
    return pc.list_flatten(row.column("ids")).combine_chunks(), texts


MARKS = "block long, starts binary, lengths binary, asked binary, entries binary, bucket int, windows binary, anchors binary, several binary"


def _marked(blocks: pa.Table, said: pa.Table, window: int, buckets: int, seed: int) -> pa.Table:
    """Windows of a block that are known to be repeated, and those at boundaries, by hash in buckets."""
    block = blocks.column("block")[0].as_py() if blocks.num_rows else None
    hashes, rows = words.word_hashes(_texts(blocks)[1], False, seed)
    verdict, found = _joined(said, "said"), list(runs(hashes, rows, window))
    none = np.zeros(0, np.int64)
    starts, lengths, anchor = (np.concatenate([none.astype(t), *(r[k] for r in found)]) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
    kind = verdict[np.searchsorted(np.unique(anchor), anchor)] if len(anchor) else np.zeros(0, np.uint8)
    sure, some = kind == REPEATED, kind == CONTESTED
    asked = words.gather(np.arange(len(hashes)), starts[some], lengths[some])
    window_of, at = [np.zeros(0, np.uint64)], np.searchsorted(asked, [r[4] for r in found] + [len(hashes)])
    for r, lo, hi in zip(found, at[:-1].tolist(), at[1:].tolist(), strict=True):
        window_of.append(r[5][asked[lo:hi] - r[4]])
    keys = np.zeros(len(asked), [("w", np.uint64), ("a", np.uint64)])
    keys["w"], keys["a"] = np.concatenate(window_of), np.repeat(anchor[some], lengths[some])
    entries, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    parts = _parts(np.ascontiguousarray(entries["w"]), buckets)
    n = len(parts)
    first = [squeeze(np.diff(starts[sure], prepend=0)), squeeze(lengths[sure]), squeeze(np.diff(asked, prepend=0)), squeeze(which)]
    last = [[x[p].tobytes() for _, p in parts] for x in (entries["w"], entries["a"], (counts > 1).astype(np.uint8))]
    columns = [pa.array([b] + [None] * n, pa.binary()) for b in first] + [pa.array([None, *(b for b, _ in parts)], pa.int32())] + [pa.array([None, *c], pa.binary()) for c in last]
    return pa.Table.from_arrays([pa.array([block] * (n + 1), pa.int64()), *columns], ["block", "starts", "lengths", "asked", "entries", "bucket", "windows", "anchors", "several"])


def _compared(rows: pa.Table) -> pa.Table:
    """Whether each window of a bucket begins at two places or more."""
    parts = rows.column("windows").to_pylist()
    keys = np.zeros(sum(len(b) // 8 for b in parts), [("w", np.uint64), ("a", np.uint64)])
    keys["w"], keys["a"] = (np.concatenate([np.frombuffer(b, np.uint64) for b in c]) for c in (parts, rows.column("anchors").to_pylist()))
    several = np.concatenate([np.frombuffer(b, np.uint8) for b in rows.column("several").to_pylist()])
    order = np.lexsort((keys["a"], keys["w"]))
    held = keys[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    which = np.empty(len(held), np.int64)
    which[order] = np.cumsum(new) - 1
    twice = ((np.bincount(which) > 1) | (np.bincount(which, several) > 0))[which].astype(np.uint8)
    ends = np.cumsum([len(b) // 8 for b in parts])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "found": pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(twice, ends[:-1])], pa.binary())})


def _covered(n: int, marks: pa.Table, window: int) -> np.ndarray:
    """Whether each word of a block is covered by a repeated window."""
    row = marks.filter(pc.is_valid(marks.column("starts")))
    starts, lengths, asked, entries = (expand(row.column(c)[0].as_py()) for c in ("starts", "lengths", "asked", "entries"))
    starts, asked, found = np.cumsum(starts), np.cumsum(asked), _joined(marks, "found")
    more = asked[found[entries] > 0] if len(asked) else asked
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths - 1 + window, -1)
    np.add.at(edges, more, 1)
    np.add.at(edges, more + window, -1)
    return np.cumsum(edges)[:n] > 0


def _cut(blocks: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    """(id, text, n_words, n_removed) of a block's documents."""
    ids, texts = _texts(blocks)
    data, offsets = words.flat(texts)
    starts, ends, before = spans_of(data, offsets)
    stay = ~_covered(len(starts), marks, window)
    kept = np.concatenate([[0], np.cumsum(stay)])[before]
    sizes = np.diff(kept)
    starts, lengths = starts[stay], (ends - starts)[stay] + 1
    joined = words.gather(np.append(data, np.uint8(32)), starts, lengths)  # each word with the byte behind it,
    places = np.cumsum(lengths)
    joined[places - 1] = 32  # which is made a blank,
    last = kept[1:][sizes > 0] - 1
    out = np.delete(joined, places[last] - 1)  # but for the last word of a text
    length = np.concatenate([[0], places])[kept]
    width = np.diff(length) - (sizes > 0)
    at = np.concatenate([[0], np.cumsum(width)])
    made = pa.LargeStringArray.from_buffers(len(width), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
    total = np.diff(before)
    return pa.table({"id": ids, "text": made.cast(pa.string()), "n_words": pa.array(total), "n_removed": pa.array(total - sizes)})


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, buckets: int | None = None) -> DataFrame:
    """(id, text, n_words, n_removed) per row: texts without the words covered by a repeated window.

    A word is a run of characters other than white space, compared as it is. A window of `window`
    words (at most 64) is repeated if its sequence also begins at any other place, in the same row or
    another; all its occurrences go. Windows are judged on the input. What is left is joined by single
    blanks. Null and empty texts have no words and come back empty. Ids may be null or repeat: each
    row is a text of its own. Other columns are ignored.

    Windows are compared by two 64-bit hashes with a seed drawn for each call. The index is dealt in
    ranges of hashes; an anchor or a window stands there once for each block that has it, however
    often it occurs.
    """
    if not 1 <= window <= 64:
        raise ValueError("a window has 1 to 64 words")
    spark, kind, seed = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), secrets.randbits(63)
    parts = buckets or max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(lambda it: _indexed(it, window, parts, seed), BLOCKS.format(id=kind)), "passage-blocks")
    index = blocks.filter("bucket is not null").select("block", "bucket", "anchors", "around", "several")
    said = index.groupBy("bucket").applyInArrow(_looked_up, "block long, bucket int, said binary")
    texts = blocks.filter("texts is not null").select("block", "ids", "sizes", "texts")
    marks = texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(lambda a, b: _marked(a, b, window, parts, seed), MARKS)
    marks = stored(marks, "passage-marks")
    found = marks.filter("bucket is not null").select("block", "bucket", "windows", "anchors", "several").groupBy("bucket").applyInArrow(_compared, "block long, bucket int, found binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("starts", "lengths", "asked", "entries")]
    marks = marks.filter("starts is not null").select("block", "starts", "lengths", "asked", "entries", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("found"))
    marks = marks.unionByName(found.select("block", *none, "bucket", "found"))
    out = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda a, b: _cut(a, b, window), f"id {kind}, text string, n_words long, n_removed long")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed")


def op11_rlz_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM t WHERE len(w) >= 35),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM p),
d AS (SELECT doc_id, i FROM g WHERE s IN (SELECT s FROM g GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, (SELECT unnest(range(35)) AS k)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS kept, count(*) AS n FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""

"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, texts are put together by position."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.blocks import expand, join_bytes, split_bytes, squeeze

#: Text bytes after which a block ends: its ids are put together in one piece of memory.
BLOCK_BYTES = 18_000_000
#: Documents in a row: their word numbers are compressed together.
TOGETHER = 64
#: Characters from which a text's pre-tokens are found in runs, and the pre-tokens or ids of a run.
LONG, RUN = 500_000, 200_000
#: Words of a bucket that a task remembers the ids of, before it starts afresh.
REMEMBERED = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _block_rows(batches: Iterable[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (block, ids, sizes, seq: word numbers end to end) and of the words of a bucket (block, bucket, places, names)."""
    import regex

    compiled, block, size, numbers = regex.compile(pattern), TaskContext.get().partitionId() << 24, 0, {}
    kind = None
    names = ["block", "ids", "sizes", "seq", "bucket", "places", "names"]

    def found(text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text; those of a long one in runs, so that they are never held together."""
        if len(text) < LONG:
            yield compiled.findall(text)
            return
        matches = compiled.finditer(text)
        while run := [m.group() for m in islice(matches, RUN)]:
            yield run

    def vocabulary() -> pa.RecordBatch:
        held = [w.encode() for w in numbers]
        of = np.fromiter((zlib.crc32(w) % buckets for w in held), np.int64, len(held))
        order = np.argsort(of, kind="stable")
        used, first = np.unique(of[order], return_index=True)
        parts = np.split(order, first[1:])
        n = len(used)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.list_(kind)), *[pa.nulls(n, pa.binary())] * 2, pa.array(used, pa.int32()), pa.array([squeeze(np.diff(p, prepend=0)) for p in parts], pa.binary()), pa.array([join_bytes([held[k] for k in p.tolist()]) for p in parts], pa.binary())], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for at, texts in words.slices(batch.column(1)):
            rows: list[tuple] = []
            for lo in range(0, len(texts), TOGETHER):
                some = texts.slice(lo, TOGETHER)
                sizes, runs = np.zeros(len(some), np.int64), [np.zeros(0, np.uint32)]
                for k, text in enumerate(some):
                    for run in found(text.as_py() or ""):
                        size += sum(map(len, run))
                        runs.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in run), np.uint32, len(run)))
                        sizes[k] += len(run)
                seq = np.concatenate(runs)
                ids = batch.column(0).slice(at + lo, len(some)).to_pylist()
                rows.append((ids, squeeze(sizes), squeeze(seq)))
            n, columns = len(rows), list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(columns[0], pa.list_(kind)), *[pa.array(c, pa.binary()) for c in columns[1:]], pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 2], names)
            if size >= BLOCK_BYTES:
                yield vocabulary()
                block, size, numbers = block + 1, 0, {}
    if numbers:
        yield vocabulary()


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.filter(pc.is_valid(batch.column(4)))
        yield pa.RecordBatch.from_arrays([rows.column(k) for k in (0, 4, 5, 6)], ["block", "bucket", "places", "names"])


def _encoded(batches: Iterable[pa.RecordBatch], pattern: str, ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of each row. Rows come sorted by bucket, so a word is encoded once and then forgotten with its bucket."""
    import tiktoken

    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    last, known = None, {}
    for batch in batches:
        sizes, ids, used = [], [], []
        for bucket, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if bucket != last or len(known) > REMEMBERED:
                last, known = bucket, {}
            found = []
            for word in split_bytes(data):
                got = known.get(word)
                if got is None:
                    got = known[word] = encoder.encode_ordinary(word.decode())
                found.append(got)
            sizes.append(squeeze(np.fromiter(map(len, found), np.int64, len(found))))
            flat = np.fromiter((i for got in found for i in got), np.int64)
            ids.append(squeeze(flat))
            used.append(np.unique(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary()), pa.array(used, pa.list_(pa.int32()))], ["block", "places", "sizes", "ids", "used"])


def _runs(values: np.ndarray) -> Iterator[np.ndarray]:
    return (values[lo : lo + RUN] for lo in range(0, len(values), RUN))


def _assembled(docs: pa.Table, entries: pa.Table, decoded: bool) -> pa.Table:
    """Ids of each document of a block and, if `decoded`, the bytes that they stand for by the block's rows of the token table."""
    docs = docs.filter(pc.is_valid(docs.column("seq")))
    words_ = entries.filter(pc.is_valid(entries.column("places")))
    rows = [[expand(x) for x in words_.column(c).to_pylist()] for c in ("places", "sizes", "ids")]
    places = np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, rows[0])])
    sizes, ids = (np.concatenate([np.zeros(0, np.int64), *r]) for r in rows[1:])
    lengths, starts = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    lengths[places], starts[places] = sizes, np.cumsum(sizes) - sizes
    ids, out, ends = ids.astype(np.int32), [], [0]
    for sizes, seq in zip(docs.column("sizes").to_pylist(), docs.column("seq").to_pylist(), strict=True):
        at = expand(seq)
        out += [words.gather(ids, starts[run], lengths[run]) for run in _runs(at)]
        for run in np.split(at, np.cumsum(expand(sizes))[:-1]):
            ends.append(ends[-1] + int(lengths[run].sum()))
    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
    columns = {"id": pc.list_flatten(docs.column("ids")), "tokens": tokens}
    if decoded:
        known = entries.filter(pc.is_valid(entries.column("token")))
        table = TokenBytes(dict(zip(known.column("token").to_pylist(), known.column("bytes").to_pylist(), strict=True)))
        # a slice at a time: looking bytes up holds some 30 bytes for each byte of text
        some = [table.of(tokens.slice(at, 200)) for at in range(0, len(tokens), 200)]
        columns["decoded"] = pa.chunked_array(some, pa.binary())
    return pa.table(columns)


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(token, bytes): the rank file as a table; its size is the vocabulary's."""
    return spark.createDataFrame([(k, bytearray(b)) for b, k in read_ranks(ranks_path).items()], "token int, bytes binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, decoded: bool = False) -> DataFrame:
    """(id, tokens array<int>) per row, as the rank file's own library gives for ordinary text.

    Pre-tokens by `pattern` are numbered within blocks of documents; the distinct ones of all blocks
    are shuffled by word, a row for the words of a block in each of `buckets` parts (512, or as many
    as a shuffle has partitions if that is more), encoded once each, and sent back to their blocks,
    where the documents are reassembled by position. Null and empty texts have no tokens. Ids may be
    null or repeat: rows are encoded one by one. Other columns are ignored.

    With `decoded`, the distinct ids of each block are joined with the table of token bytes, and each
    document's bytes are put together from them by position, into a column `decoded`.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    parts = buckets or max(512, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = rows.mapInArrow(lambda it: _block_rows(it, pattern, parts), f"block long, ids array<{kind}>, sizes binary, seq binary, bucket int, places binary, names binary").repartition("block")
    entries = blocks.mapInArrow(_vocabulary, "block long, bucket int, places binary, names binary").repartition("bucket").sortWithinPartitions("bucket")
    known = entries.mapInArrow(lambda it: _encoded(it, pattern, ranks_path), "block long, places binary, sizes binary, ids binary, used array<int>")
    none = [F.lit(None).cast("int").alias("token"), F.lit(None).cast("binary").alias("bytes")]
    if decoded:
        known = known.repartition("block")
        used = known.select("block", F.explode("used").alias("token")).distinct().join(F.broadcast(token_table(spark, ranks_path)), "token")
        bytes_ = used.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("places", "sizes", "ids")], "token", "bytes")
        known = known.select("block", "places", "sizes", "ids", *none).unionByName(bytes_)
    else:
        known = known.select("block", "places", "sizes", "ids", *none)
    made = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _assembled(a, b, decoded), f"id {kind}, tokens array<int>" + ", decoded binary" * decoded)
    return made.withColumnRenamed("id", id_col)


class TokenBytes:
    """Bytes of tokens end to end, found by id."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        width = max(tokens, default=-1) + 1
        self.starts, self.lengths = np.zeros(width, np.int64), np.full(width, -1, np.int64)
        ids, sizes = np.fromiter(tokens, np.int64, len(tokens)), np.fromiter(map(len, tokens.values()), np.int64, len(tokens))
        self.starts[ids], self.lengths[ids] = np.cumsum(sizes) - sizes, sizes
        self.data = np.frombuffer(b"".join(tokens.values()), np.uint8)

    def of(self, column: pa.Array) -> pa.Array:
        """Bytes of each array of ids; null gives null, an unknown id fails."""
        ids = column.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or any(self.lengths[run].min() < 0 for run in _runs(ids))):
            raise ValueError("unknown token id")
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        rows = len(column)
        data = np.concatenate([np.zeros(0, np.uint8), *[words.gather(self.data, self.starts[run], self.lengths[run]) for run in _runs(ids)]])
        ends = np.cumsum([0, *[int(self.lengths[ids[a:b]].sum()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]], dtype=np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        return pc.if_else(column.is_valid(), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def decode(tokens: Column, ranks_path: str) -> Column:
    """Bytes of an array of ids, looked up in the table of token bytes (its size is the vocabulary's).

    Null gives null, an empty array no bytes; an id that is not in the table fails.
    """

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        return _whole_table(ranks_path).of(column)

    return joined(tokens)


@lru_cache(2)
def _whole_table(ranks_path: str) -> TokenBytes:
    return TokenBytes({k: b for b, k in read_ranks(ranks_path).items()})


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

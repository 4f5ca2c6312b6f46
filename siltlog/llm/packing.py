"""Packing of tokenised documents into training windows by Karmarkar-Karp differencing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import kk, words

PIECES = "id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Words that a worker remembers the ids of, about 200 bytes each, before those not met since go.
REMEMBERED = 100_000
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
_LEVEL = {**{b: b for b in _SHOWN}, **{b: 256 + k for k, b in enumerate(_HIDDEN)}}


class WordTokenizer:
    """Ids of whole texts by a lower-casing byte-level tokenizer whose words never cross a blank.

    Words of many texts are found and hashed as arrays; only words that the worker has not met go to
    the tokenizer. A mark right after an ASCII letter begins a word of its own, as in the tokenizer.
    With `specials`, the tokenizer's own strings (such as an end mark) stand for their tokens wherever
    a text holds them, as the tokenizer reads them; else they are ordinary text.
    """

    def __init__(self, path: str, specials: bool = False) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what reaches it is ordinary text
        added = {t.content.encode(): k for k, t in self.tokenizer.get_added_tokens_decoder().items()} if specials else {}
        if any(words.BLANK[np.frombuffer(t, np.uint8)].any() for t in added):
            raise ValueError("a special token must not hold white space")
        self.added = added
        self.special = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Letters of Latin-1 pass the normaliser as lower case and are one pre-token: straight to the merges."""
        if word.isalpha() and max(word) <= "\xff":
            low = word.lower()
            return [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_LEVEL))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, word: bytes) -> bytes:
        got = self.older.get(word) or np.array(self.word(word.decode("utf-8", "replace")), "<u4").tobytes()
        self.known[word] = got
        return got

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, token) of the special strings in a run of bytes; none goes on from one text into the next."""
        raw = data.tobytes() if self.special else b""
        if not any(t in raw for t in self.added):
            return []
        found = []
        for lo, hi in zip([0, *offsets.tolist()], [*offsets.tolist(), len(raw)]):
            found += [(m.start(), m.end(), self.added[m.group()]) for m in self.special.finditer(raw, lo, hi)]
        return found

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of bytes that cuts no word, and how many of them stand before each offset."""
        breaks = np.zeros(len(data), bool)
        breaks[1:] = _MARKS[data[1:]] & _LETTERS[data[:-1]]
        found = self._specials(data, offsets)
        for at, end, _ in found:  # a word of its own
            breaks[at] = True
            breaks[at + 1 : end] = False
            breaks[end : end + 1] = True
        starts, ends, rows = words.spans(data, offsets, breaks)
        hashes = words.hash_spans(data, starts, ends)
        special = dict(zip(np.searchsorted(starts, [at for at, *_ in found]).tolist(), (k for *_, k in found), strict=True))
        for word, k in special.items():
            hashes[word] = words.mix(np.array([k + 1], np.uint64))[0]  # apart from its letters in capitals
        while True:
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            other = ~words.equal_spans(data, starts, ends, first[which])
            if not other.any():
                break
            hashes[other] = words.mix(hashes[other] + np.uint64(1))  # unequal words of one hash
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        raw = data.tobytes().lower()  # A-Z only
        distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        got = [self.known.get(word) or self._learn(word) for word in distinct]
        for entry, word in enumerate(first.tolist()) if special else ():
            if word in special:
                got[entry] = np.array([special[word]], "<u4").tobytes()
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        begins = np.cumsum(lengths) - lengths
        tokens = words.gather(np.frombuffer(b"".join(got), "<u4"), begins[which], lengths[which])
        return tokens, np.concatenate([[0], np.cumsum(lengths[which])])[rows]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each row of a text column its ids; null counts as empty. Words are known by their bytes."""
        data, offsets = words.flat(column)
        held: list[np.ndarray] = [np.zeros(0, "<u4")]
        end = 0
        for lo, hi, first, end in words.parts(data, offsets):
            tokens, before = self._part(data[lo:hi], offsets[first:end] - lo)
            last = 0
            for row, cut in zip(range(first, end), before.tolist(), strict=True):
                if row:
                    yield np.concatenate([*held, tokens[last:cut]])
                    held = held[:1]
                last = cut
            held.append(tokens[last:])
        for row in range(end, len(offsets)):
            if row:
                yield np.concatenate(held)
                held = held[:1]


class _Windows:
    """Builds the output rows of one task."""

    def __init__(self, capacity: int, piece: int, group: int, first: int, schema: pa.Schema) -> None:
        self.capacity, self.piece, self.group, self.next, self.schema = capacity, piece, group * capacity, first, schema
        self.open: list[tuple] = []
        self.open_tokens = 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def _emit(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[-1])

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.capacity
        for at in range(0, full, self.capacity):
            self._emit((doc, at, self.capacity, n, self.next, 0, ids[at : at + self.capacity].tobytes()))
            self.next += 1
        for at in range(full, n, self.piece):
            part = ids[at : at + self.piece]
            self.open.append((doc, at, len(part), n, part.tobytes()))
        self.open_tokens += n - full
        if self.open_tokens >= self.group:
            self.close()

    def close(self) -> None:
        if not self.open:
            return
        bins, windows = kk.pack(np.array([p[2] for p in self.open], np.int64), self.capacity)
        filled = np.zeros(windows, np.int64)
        for (doc, at, length, n, data), b in zip(self.open, bins.tolist(), strict=True):
            self._emit((doc, at, length, n, self.next + b, int(filled[b]), data))
            filled[b] += length
        self.next += windows
        self.open, self.open_tokens = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema, strict=True)], schema=self.schema)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, piece: int = 512, group_windows: int = 128, specials: bool = False) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's tokens, closed by `end_id`, give full windows first; what is left over is cut into
    pieces of at most `piece` tokens. A task gathers left-over pieces of about `group_windows`
    windows and deals them to windows by Karmarkar-Karp differencing, raising the window count
    until none exceeds `capacity`. Everything happens where the text is read: no shuffle, and a lost
    task gives the same rows again. A worker holds one group, the words it remembers and the ids of
    one text; texts of any length are taken in parts. With `specials`, the tokenizer's special strings
    in a text are their tokens, as it reads them itself; else they are ordinary text.

    Null text counts as empty (the document is its end id). Null and repeated ids are packed row by
    row, each row as a document of its own. Other columns are ignored. No rows in, no rows out.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = WordTokenizer(tokenizer, specials), None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
            out = out or _Windows(capacity, piece, group_windows, TaskContext.get().partitionId() << 33, schema)
            for doc, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                out.add(doc, np.append(tokens, np.uint32(end_id)).astype("<u4"))
                if out.bytes > 4_000_000:
                    yield out.take()
            del batch
            pa.default_memory_pool().release_unused()
        if out:
            out.close()
            if out.rows:
                yield out.take()

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(id=kind.simpleString()))
    return made.withColumnRenamed("id", id_col)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), specials=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

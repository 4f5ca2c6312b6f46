"""Brown class-based bigrams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.blocks import BLOCK_BYTES, expand, squeeze
from siltlog.llm.shared import stored

#: The closing token's hash and class, and the class from which on words are exchanged.
END, END_CLASS, FIRST_CLASS = np.uint64(0x5EED0FE11D0C5EED), 0, 1
#: Classes in all; exchanged ones start as 8 frequency bands of equal numbers of classes.
CLASSES, BANDS = 33, 8
#: Share of a word's count that the class of unknown words keeps for them.
DISCOUNT = 0.5
#: Words in a row of packed contexts.
PACKED = 20_000


def held_out(doc_id, parts: int, part: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == part


def _runs(values: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """`order`, which sorts `values`, cut where the value changes."""
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


def _block_rows(batches: Iterable[pa.RecordBatch], parts: int, part: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Document rows (block, id, held, seq) and a row for the words of each bucket (block, bucket, places, hashes, counts in training)."""
    block, size, docs, kind = TaskContext.get().partitionId() << 24, 0, [], None
    names = ["block", "id", "held", "seq", "bucket", "places", "hashes", "counts"]

    def flush() -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([d[2] for d in docs])
        train = np.repeat([not d[1] for d in docs], [len(d[2]) for d in docs])
        hashes, which = np.unique(tokens, return_inverse=True)
        rank = np.argsort(-np.bincount(which), kind="stable")  # frequent words get small numbers
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        which, hashes = number[which], hashes[rank]
        counts = np.bincount(which[train], minlength=len(hashes))
        ends = np.cumsum([len(d[2]) for d in docs])
        for at in range(0, len(docs), 2000):
            some = docs[at : at + 2000]
            seqs = [squeeze(which[e - len(d[2]) : e]) for d, e in zip(some, ends[at : at + 2000].tolist(), strict=True)]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([d[0] for d in some], kind), pa.array([d[1] for d in some]), pa.array(seqs, pa.binary()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], names)
        of = (hashes % np.uint64(buckets)).astype(np.int64)
        rows = [(int(of[p[0]]), squeeze(np.diff(p, prepend=0)), hashes[p].tobytes(), squeeze(counts[p])) for p in _runs(of, np.argsort(of, kind="stable"))]
        n, columns = len(rows), list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for at, texts in words.slices(batch.column(1)):
            hashes, rows = words.word_hashes(texts)
            for k, doc in enumerate(batch.column(0).slice(at, len(texts)).to_pylist()):
                docs.append((doc, held_out(doc, parts, part), np.append(hashes[rows[k] : rows[k + 1]], END)))
            size += len(hashes) * 6
            if size >= BLOCK_BYTES:
                yield from flush()
                block, size, docs = block + 1, 0, []
    if docs:
        yield from flush()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, hashes, counts, n, v) of the words of each bucket, sorted; rows come sorted by bucket."""
    last, held, size = None, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        names, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        return names, np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)

    def done() -> pa.RecordBatch:
        names, total = fold()
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([names.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], ["bucket", "hashes", "counts", "n", "v"])

    for batch in batches:
        for bucket, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and held:
                yield done()
                held, size = [], 0
            last = bucket
            held.append((np.frombuffer(hashes, np.uint64), expand(counts)))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [fold()]
                size = len(held[0][0]) // 2  # folding again pays only after as much has come in
    if held:
        yield done()


def _start(hashes: np.ndarray, counts: np.ndarray, classes: int, unknown: int) -> np.ndarray:
    """Classes to begin with: by frequency band, and by hash within a band."""
    each = max(1, (classes - FIRST_CLASS) // BANDS)
    band = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BANDS - 1)
    kinds = FIRST_CLASS + (band * each + (hashes % np.uint64(each)).astype(np.int64)) % max(1, classes - FIRST_CLASS)
    return np.where(hashes == END, END_CLASS, np.where(counts > 0, kinds, unknown))


def _looked_up(batches: Iterable[pa.RecordBatch], classes: int, unknown: int) -> Iterator[pa.RecordBatch]:
    """Classes and counts of the words of each block.

    Rows come sorted by bucket, and within it the counted words (turn 0), their classes (1), the words of blocks (2).
    """
    names = counts = kinds = None
    out: list[tuple] = []

    def take() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out))], ["block", "places", "hashes", "kinds", "counts"])
        out.clear()
        return made

    for batch in batches:
        for turn, block, places, hashes, values in zip(*(batch.column(c).to_pylist() for c in ("turn", "block", "places", "hashes", "values")), strict=True):
            found = np.frombuffer(hashes, np.uint64)
            if turn == 0:
                names, counts = found, np.frombuffer(values, np.int64)
                kinds = _start(names, counts, classes, unknown)
            elif turn == 1:
                kinds[np.searchsorted(names, found)] = expand(values)
            else:
                at = np.searchsorted(names, found)
                out.append((block, places, hashes, squeeze(kinds[at]), counts[at].tobytes()))
                if len(out) >= 500:
                    yield take()
    if out:
        yield take()


def _mass(batches: Iterable[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """(class, n, v): tokens and distinct words of training in each class; rows as for `_looked_up`, without blocks."""
    n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    held = None

    def add() -> None:
        kinds, counts = held
        np.add.at(n, kinds[counts > 0], counts[counts > 0])
        np.add.at(v, kinds[counts > 0], 1)

    for batch in batches:
        for turn, hashes, values in zip(*(batch.column(c).to_pylist() for c in ("turn", "hashes", "values")), strict=True):
            found = np.frombuffer(hashes, np.uint64)
            if turn == 0:
                if held:
                    add()
                names, counts = found, np.frombuffer(values, np.int64)
                held = _start(names, counts, classes, FIRST_CLASS), counts
            else:
                held[0][np.searchsorted(names, found)] = expand(values)
    if held:
        add()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes), pa.int32()), pa.array(n), pa.array(v)], ["class", "n", "v"])


def _numbered(entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, hash and count of a block's words by their numbers."""
    places = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(expand(p)) for p in entries.column("places").to_pylist())])
    kind, names, counts = np.zeros(len(places), np.int64), np.zeros(len(places), np.uint64), np.zeros(len(places), np.int64)
    for out, column, read in ((kind, "kinds", expand), (names, "hashes", lambda b: np.frombuffer(b, np.uint64)), (counts, "counts", lambda b: np.frombuffer(b, np.int64))):
        out[places] = np.concatenate([out[:0], *map(read, entries.column(column).to_pylist())])
    return kind, names, counts


def _contexts(docs: pa.Table, entries: pa.Table, classes: int, buckets: int) -> pa.Table:
    """Counts of a block's words by the class before (slots from 0) and after (from `classes`).

    A row for the words of each bucket: hashes, classes, slots of each, and slots and counts end to end.
    """
    columns = ["bucket", "hashes", "kinds", "sizes", "slots", "counts"]
    rows: list[tuple] = []
    if docs.num_rows and entries.num_rows:
        seqs = [expand(s) for s in docs.column("seq").to_pylist()]
        tokens = np.concatenate(seqs)
        kind, hashes, _ = _numbered(entries)
        of = kind[tokens]
        starts = np.cumsum([0, *map(len, seqs)])
        before = np.concatenate([[END_CLASS], of[:-1]])
        before[starts[:-1]] = END_CLASS
        after = np.concatenate([of[1:], [END_CLASS]])
        mine = of >= FIRST_CLASS
        keys = np.concatenate([tokens[mine] * 2 * classes + before[mine], tokens[mine] * 2 * classes + classes + after[mine]])
        keys, counts = np.unique(keys, return_counts=True)
        word, slot = keys // (2 * classes), keys % (2 * classes)
        place, sizes = np.unique(word, return_counts=True)
        bucket = (hashes[place] % np.uint64(buckets)).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        for some in _runs(bucket, np.argsort(bucket, kind="stable")):
            at = words.gather(np.arange(len(keys)), begins[some], sizes[some])
            rows.append((int(bucket[some[0]]), hashes[place[some]].tobytes(), squeeze(kind[place[some]]), squeeze(sizes[some]), squeeze(slot[at]), squeeze(counts[at])))
    return pa.Table.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows) if rows else [[]] * 6)], columns)


CONTEXTS = "bucket int, hashes binary, kinds binary, sizes binary, slots binary, counts binary"


def _packed(bucket: list, hashes: list, kinds: list, sizes: list, slots: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(c, pa.binary()) for c in (hashes, kinds, sizes, slots, counts)]], ["bucket", "hashes", "kinds", "sizes", "slots", "counts"])


def _summed(batches: Iterable[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Contexts of each word over all blocks, counts as 64 bits; rows come sorted by bucket. What is held is folded as it grows, to 2 * classes numbers a word at most."""
    last, held, size = None, [], 0

    def fold() -> tuple[np.ndarray, ...]:
        hashes, kinds, slots, counts = (np.concatenate(c) for c in zip(*held))
        names, which = np.unique(hashes, return_inverse=True)
        of = np.zeros(len(names), np.int64)
        of[which] = kinds
        keys, back = np.unique(which * 2 * classes + slots, return_inverse=True)
        word = keys // (2 * classes)
        return names[word], of[word], keys % (2 * classes), np.bincount(back, counts).astype(np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        hashes, kinds, slots, counts = fold()
        names, first, sizes = np.unique(hashes, return_index=True, return_counts=True)
        ends = np.append(first, len(hashes))
        for at in range(0, len(names), PACKED):
            to = min(at + PACKED, len(names))
            some = slice(ends[at], ends[to])
            yield _packed([last], [names[at:to].tobytes()], [squeeze(kinds[first[at:to]])], [squeeze(sizes[at:to])], [squeeze(slots[some])], [counts[some].tobytes()])

    for batch in batches:
        for bucket, hashes, kinds, sizes, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and held:
                yield from done()
                held, size = [], 0
            last, sizes = bucket, expand(sizes)
            held.append((np.repeat(np.frombuffer(hashes, np.uint64), sizes), np.repeat(expand(kinds), sizes), expand(slots), expand(counts)))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [fold()]
                size = len(held[0][0]) // 2  # folding again pays only after as much has come in
    if held:
        yield from done()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _class_sums(batches: Iterable[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """(cell, n): contexts added up by class; cell is class * 2 * classes + slot."""
    sums = np.zeros(classes * 2 * classes, np.int64)
    for batch in batches:
        for kinds, sizes, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("kinds", "sizes", "slots", "counts")), strict=True):
            cells = np.repeat(expand(kinds), expand(sizes)) * 2 * classes + expand(slots)
            sums += np.bincount(cells, np.frombuffer(counts, np.int64), minlength=len(sums)).astype(np.int64)
    cells = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(sums[cells])], ["cell", "n"])


def _moved(hashes, kinds, sizes, slots, counts, sums: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """The class of each word in which the likelihood gains most from it, for the words whose turn it is."""
    classes, total = len(sums), sums[:, : len(sums)].sum(axis=1)
    held, kinds = _xlogx(sums), kinds.copy()
    mine = np.flatnonzero(words.mix(hashes) % np.uint64(turns) == turn)
    ends = np.cumsum(sizes)
    for at in range(0, len(mine), 4096):
        some = mine[at : at + 4096]
        entry = words.gather(np.arange(len(slots)), (ends - sizes)[some], sizes[some])
        s, x, row = slots[entry], counts[entry].astype(np.float64), np.repeat(np.arange(len(some)), sizes[some])
        begins = np.cumsum(sizes[some]) - sizes[some]
        n = np.add.reduceat(x * (s < classes), begins)
        gain = np.add.reduceat(_xlogx(sums[:, s] + x) - held[:, s], begins, axis=1) - 2 * (_xlogx(total[:, None] + n) - _xlogx(total)[:, None])
        own = kinds[some]
        of = own[row]
        stay = np.add.reduceat(held[of, s] - _xlogx(sums[of, s] - x), begins) - 2 * (_xlogx(total[own]) - _xlogx(total[own] - n))
        gain[own, np.arange(len(some))] = stay
        gain[:FIRST_CLASS] = -np.inf
        kinds[some] = gain.argmax(axis=0)
    return kinds


def _exchanged(batches: Iterable[pa.RecordBatch], sums: np.ndarray, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = []
        for hashes, old, sizes, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("hashes", "kinds", "sizes", "slots", "counts")), strict=True):
            kinds.append(squeeze(_moved(np.frombuffer(hashes, np.uint64), expand(old), expand(sizes), expand(slots), np.frombuffer(counts, np.int64), sums, turn, turns)))
        yield batch.set_column(2, "kinds", pa.array(kinds, pa.binary()))


def _sums_of(contexts: DataFrame, classes: int) -> tuple[np.ndarray, float]:
    """Context sums of each class, which is all that the driver gathers, and the likelihood that they stand for, in nats a token."""
    sums = np.zeros(classes * 2 * classes)
    for r in contexts.select("kinds", "sizes", "slots", "counts").mapInArrow(lambda it: _class_sums(it, classes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    sums = sums.reshape(classes, 2 * classes)
    total = sums[:, :classes].sum(axis=1)
    return sums, float(_xlogx(sums).sum() / 2 - _xlogx(total).sum()) / max(1.0, total.sum())


def exchange(contexts: DataFrame, classes: int, turns: int = 2, gain: float = 0.01, most: int = 8) -> tuple[DataFrame, float]:
    """Sweeps of exchange over packed contexts: in each turn a share of the words moves at once.

    Sweeps go on until one raises the likelihood by less than `gain` nats a token, or `most` are done;
    one that lowers it is taken back. Returns the contexts with their classes and the likelihood before.
    """
    sums, value = _sums_of(contexts, classes)
    first = value
    for _ in range(most):
        moved = contexts
        for turn in range(turns):
            now = sums if turn == 0 else _sums_of(moved, classes)[0]
            moved = stored(moved.mapInArrow(lambda it, s=now, t=turn: _exchanged(it, s, t, turns), CONTEXTS), "classes")
        sums, after = _sums_of(moved, classes)
        if after <= value:
            break
        contexts, more, value = moved, after - value, after
        if more < gain:
            break
    return contexts, first


@dataclass
class Corpus:
    """Numbered documents, their words by block and bucket, and the counted words of each bucket."""

    texts: DataFrame
    entries: DataFrame
    words: DataFrame
    tokens: int
    distinct: int
    buckets: int

    def known(self, label: DataFrame | None, blocks: bool) -> DataFrame:
        """Counted words, classes, and words of blocks, in the order in which they are looked up."""
        none = F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("places")
        rows = self.words.select("bucket", F.lit(0).alias("turn"), *none, "hashes", F.col("counts").alias("values"))
        if label is not None:
            rows = rows.unionByName(label.select("bucket", F.lit(1).alias("turn"), *none, "hashes", F.col("kinds").alias("values")))
        if blocks:
            rows = rows.unionByName(self.entries.select("bucket", F.lit(2).alias("turn"), "block", "places", "hashes", F.lit(None).cast("binary").alias("values")))
        return rows.repartition("bucket").sortWithinPartitions("bucket", "turn")

    def by_block(self, label: DataFrame | None, classes: int, unknown: int) -> DataFrame:
        return self.known(label, True).mapInArrow(lambda it: _looked_up(it, classes, unknown), "block long, places binary, hashes binary, kinds binary, counts binary")


def number(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, buckets: int | None = None) -> Corpus:
    """The corpus as numbers, with the counts of its training words."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    buckets = buckets or max(512, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(lambda it: _block_rows(it, parts, part, buckets), f"block long, id {kind}, held boolean, seq binary, bucket int, places binary, hashes binary, counts binary"), "blocks")
    entries = blocks.filter("bucket is not null").select("block", "bucket", "places", "hashes", "counts")
    sorted_ = entries.select("bucket", "hashes", "counts").repartition("bucket").sortWithinPartitions("bucket")
    counted = stored(sorted_.mapInArrow(_counted, "bucket int, hashes binary, counts binary, n long, v long"), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return Corpus(blocks.filter("seq is not null").select("block", "id", "held", "seq"), entries, counted, total["n"], total["v"], buckets)


def cluster(corpus: Corpus, classes: int = CLASSES, passes: int = 2, gain: float = 0.01) -> DataFrame | None:
    """(bucket, hashes, kinds) of every training word; None where there is none.

    A pass counts the contexts of all words over all training text by the classes of their neighbours,
    then exchanges. Passes end when one begins with less than `gain` nats a token above the one before.
    """
    label, last, buckets = None, None, corpus.buckets
    train = corpus.texts.filter(~F.col("held"))
    for _ in range(passes if corpus.distinct else 0):
        known = corpus.by_block(label, classes, FIRST_CLASS)
        found = train.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _contexts(a, b, classes, buckets), CONTEXTS)
        found = found.repartition("bucket").sortWithinPartitions("bucket")
        contexts, value = exchange(stored(found.mapInArrow(lambda it: _summed(it, classes), CONTEXTS), "contexts"), classes, gain=gain)
        label = contexts.select("bucket", "hashes", "kinds")
        if last is not None and value - last < gain:
            break
        last = value
    return label


def _measured(docs: pa.Table, entries: pa.Table, mass: np.ndarray, unknown: int, tokens_all: int, distinct: int) -> pa.Table:
    """Per document its counts, base score, emission score and class transitions; per block the transitions of training."""
    names = ["id", "held", "n_tokens", "n_known", "base_score", "emission", "steps", "counts", "totals"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    if not docs.num_rows:
        return pa.Table.from_arrays([docs.column("id"), *[pa.nulls(0, k) for k in kinds]], names)
    kind, hashes, count = _numbered(entries)
    classes, n, kept = len(mass), mass[:, 0], np.where(np.arange(len(mass)) == unknown, DISCOUNT, 0.0)
    share = np.where(count > 0, count - kept[kind], DISCOUNT * mass[unknown, 1])
    emission = np.where((hashes == END) | (n[kind] == 0), 0.0, np.log10(np.maximum(share, 1e-300) / np.maximum(n[kind], 1)))
    base = np.log10((count + 1) / (tokens_all + distinct + 1))
    rows: list[list] = [[] for _ in range(7)]
    totals = np.zeros(classes * classes, np.int64)
    for held, data in zip(docs.column("held").to_pylist(), docs.column("seq").to_pylist(), strict=True):
        seq = expand(data)
        of = kind[seq]
        steps, times = np.unique(np.concatenate([[END_CLASS], of[:-1]]) * classes + of, return_counts=True)
        if not held:
            totals[steps] += times
        for out, value in zip(rows, (held, len(seq), int((count[seq] > 0).sum()), float(base[seq].sum()), float(emission[seq].sum()), steps.astype(np.int32), times.astype(np.int32)), strict=True):
            out.append(value)
    one = pa.Table.from_arrays([docs.column("id"), *[pa.array(v, k) for v, k in zip(rows, kinds, strict=False)], pa.nulls(docs.num_rows, kinds[-1])], names)
    two = pa.Table.from_arrays([pa.nulls(1, docs.column("id").type), *[pa.nulls(1, k) for k in kinds[:-1]], pa.array([totals], kinds[-1])], names)
    return pa.concat_tables([one, two])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, passes: int = 2, gain: float = 0.01, smoothing: float = 0.5, parts: int = 7, part: int = 2, buckets: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row.

    Training documents are those whose crc32(id as text) mod `parts` is not `part`. Every word of
    training belongs to one of the classes, found by exchange over counts of all training text by the
    classes before and after. `score` is the log10 probability of the text and its end by smoothed
    class transitions and emissions. Unknown words are of the class with the most distinct words,
    which takes DISCOUNT of each word's count for them; all unknown words together are one event.

    Null and empty texts are their end alone. Rows that repeat an id, or have none (its text then is
    the empty one for the crc32), are documents of their own. Other columns are ignored. Without
    training text every probability is that of the smoothing. Words are told apart by 64-bit hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    corpus = number(docs, id_col=id_col, text_col=text_col, parts=parts, part=part, buckets=buckets)
    return _scored(corpus, cluster(corpus, classes, passes, gain), kind, classes, smoothing).withColumnRenamed("id", id_col)


def class_mass(corpus: Corpus, label: DataFrame | None, classes: int) -> tuple[np.ndarray, int]:
    """Tokens and distinct words of each class, and the class of unknown words."""
    mass = np.zeros((classes, 2))
    rows = corpus.known(label, False).mapInArrow(lambda it: _mass(it, classes), "class int, n long, v long")
    for r in rows.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r["class"]] = r["n"], r["v"]
    return mass, FIRST_CLASS + int(mass[FIRST_CLASS:, 1].argmax())


def _scored(corpus: Corpus, label: DataFrame | None, kind: str, classes: int, smoothing: float) -> DataFrame:
    mass, unknown = class_mass(corpus, label, classes)
    tokens, distinct = corpus.tokens, corpus.distinct
    made = corpus.texts.groupBy("block").cogroup(corpus.by_block(label, classes, unknown).groupBy("block")).applyInArrow(
        lambda a, b: _measured(a, b, mass, unknown, tokens, distinct),
        f"id {kind}, held boolean, n_tokens long, n_known long, base_score double, emission double, steps array<int>, counts array<int>, totals array<long>",
    )
    made = stored(made, "scored")
    sums = made.filter("totals is not null").select(F.posexplode("totals").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect()
    steps = np.full(classes * classes, smoothing)
    for r in sums:
        steps[r["step"]] += r["n"]
    logs = np.log10(steps / np.repeat(steps.reshape(classes, classes).sum(1), classes))

    @F.arrow_udf("double")
    def transitions(steps: pa.Array, counts: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(steps).to_numpy(zero_copy_only=False)
        parts_ = np.concatenate([[0.0], np.cumsum(logs[steps.flatten().to_numpy()] * counts.flatten().to_numpy())])
        ends_ = np.concatenate([[0], np.cumsum(sizes)])
        return pa.array(parts_[ends_[1:]] - parts_[ends_[:-1]])

    out = made.filter("totals is null").withColumn("score", F.col("emission") + transitions("steps", "counts"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("perplexity")

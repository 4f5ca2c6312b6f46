"""Phrases that occur far more often than their parts let expect, from count streams in prefix and suffix order.

The layout is that of external estimation of n-gram models. Blocks of documents give sorted streams of
padded five-word sequences, one for each place in a piece; merged in prefix order, runs of a common
beginning are the counts of all phrases of two to five words. The frequent ones are kept in two orders:
by their words from the first on, and from the last on. One lockstep pass over a sorted stream gives
each phrase the counts of its beginnings (in suffix order: of its endings) and its most frequent
extension by one word, as a phrase comes right before those that go on from it. Nothing is looked up
in a hash table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.blocks import expand, squeeze, text_blocks
from siltlog.llm.dictionary import bucket_count, entry_rows, ids_by_number, known_words, numbered, numbers, spans_of
from siltlog.llm.shared import stored

#: Words of the longest phrase.
LONGEST = 5
#: Text bytes of a block; entries of a piece of a stream; entries of a range on average, and of what is merged at once.
BLOCK_BYTES, PIECE, RANGE = 5_000_000, 1 << 16, 400_000
#: Phrases of a range in the lockstep passes, and keys that the driver gathers to cut ranges alike (for balance only).
SCANNED, SAMPLED = 400_000, 20_000
#: Keys of a range's length of a stream, from which ranges are cut.
KEYS = 100
#: Parts in which the rows of one language are ranked first.
SALTS = 64

#: A-Z lower-cased, and every mark that ends a piece as a line feed.
_PLAIN = words.LOWER.copy()
_PLAIN[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10

BLOCKS = "block long, langs array<string>, totals array<long>, of binary, seq binary, bucket int, places binary, names binary, counts binary"


def _blocks(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for the word sequence of a block (0 ends a piece), and one for its words in each bucket. A word is one of its language."""
    base = TaskContext.get().partitionId() << 24
    for k, (lang, texts) in enumerate(text_blocks(batches, BLOCK_BYTES)):
        data, offsets = words.flat(texts)
        data = _PLAIN[data]
        starts, ends, before = spans_of(data, offsets)
        codes, names = numbers(data, starts, ends)
        marks = np.flatnonzero(data == 10)
        cut = np.ones(len(starts), bool)
        cut[1:] = np.searchsorted(marks, starts[1:]) > np.searchsorted(marks, ends[:-1])
        cut[before[:-1][np.diff(before) > 0]] = True
        del data, starts, ends
        coded = pc.fill_null(lang, "und").dictionary_encode()
        langs, of = coded.dictionary, np.repeat(coded.indices.to_numpy().astype(np.int64), np.diff(before))
        pairs, which, counts = np.unique(of << 32 | codes, return_inverse=True, return_counts=True)
        word, kind = names.take(pa.array(pairs & 0xFFFFFFFF)), pairs >> 32
        tagged = pc.binary_join_element_wise(word, langs.cast(pa.large_binary()).take(pa.array(kind)), pa.scalar(b" ", pa.large_binary()))
        seq = np.insert(which + 1, np.flatnonzero(cut), 0)
        rows = entry_rows(tagged, counts, buckets)
        n = len(rows)
        totals = np.bincount(of, minlength=len(langs))
        first = [pa.array([langs.to_pylist(), *[None] * n], pa.list_(pa.string())), pa.array([totals.tolist(), *[None] * n], pa.list_(pa.int64()))]
        first += [pa.array([b, *[None] * n], pa.binary()) for b in (squeeze(kind), squeeze(seq))]
        last = list(zip(*rows)) if rows else [()] * 4
        last = [pa.array([None, *c], pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(last)]
        yield pa.RecordBatch.from_arrays([pa.array([base + k] * (n + 1)), *first, *last], ["block", "langs", "totals", "of", "seq", "bucket", "places", "names", "counts"])


def _sorted(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of columns in order, equal ones added up."""
    keys = [columns[j] if j == len(columns) - 1 else columns[j] << np.uint64(32) | columns[j + 1] for j in range(0, len(columns), 2)]
    if max((int(c.max()) for c in columns if len(c)), default=0) >> 32:
        keys = columns
    order = np.lexsort(keys[::-1])
    held = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in held]) if len(order) > 1 else True
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _pieces(blocks: pa.Table, known: pa.Table, step: int) -> pa.Table:
    """Sorted streams of a block, a row for PIECE entries of a language: (lang, n, first, keys, last, data).

    `keys` are those of one entry in `step`. Streams of like texts have like keys at like places, so
    each stream begins to count elsewhere: else all keys lie close together and the ranges between are large.
    """
    out: list[tuple] = []
    row = blocks.filter(pc.is_valid(blocks.column("seq"))) if blocks.num_rows else blocks
    if row.num_rows and known.num_rows:
        seq, of, langs = expand(row.column("seq")[0].as_py()), expand(row.column("of")[0].as_py()), row.column("langs")[0].as_py()
        ids = np.concatenate([[0], ids_by_number(known)]).astype(np.uint64)
        flow = np.concatenate([ids[seq], np.zeros(LONGEST, np.uint64)])
        begin = np.flatnonzero((flow[:-1] > 0) & (flow[1:] > 0))
        kind = of[seq[begin] - 1]
        first = np.random.default_rng(row.column("block")[0].as_py()).integers(step, size=len(langs)).tolist()
        for k, lang in enumerate(langs):
            at = begin[kind == k]
            columns = [flow[at]]
            for j in range(1, LONGEST):
                columns.append(np.where(columns[-1] > 0, flow[at + j], 0))
            columns, counts = _sorted(columns, np.ones(len(at), np.int64))
            for lo in range(0, len(counts), PIECE):
                hi = min(lo + PIECE, len(counts))
                keys = _keys(columns, range(lo + (first[k] - lo) % step, hi, step))
                out.append((lang, hi - lo, *_keys(columns, [lo]), keys, *_keys(columns, [hi - 1]), *_packed([c[lo:hi] for c in columns], counts[lo:hi])))
    names = ["lang", "n", "first", "keys", "last", *[f"c{j}" for j in range(LONGEST)], "counts"]
    key = pa.list_(pa.int64())
    types = [pa.string(), pa.int64(), key, pa.list_(key), key, *[pa.binary()] * (LONGEST + 1)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types, strict=True)], names)


PIECES = "lang string, n long, first array<long>, keys array<array<long>>, last array<long>, " + ", ".join(f"c{j} binary" for j in range(LONGEST)) + ", counts binary"
DATA = [f"c{j}" for j in range(LONGEST)] + ["counts"]


def _packed(columns: list[np.ndarray], counts: np.ndarray) -> list[bytes]:
    return [squeeze(c) for c in (*columns, counts)]


def _keys(columns: list[np.ndarray], places: Iterable[int]) -> list[list[int]]:
    return [[int(c[i]) for c in columns] for i in places]


def _ranges(keys: DataFrame, total: float, parts: int) -> list[tuple]:
    """Those of about `total` keys that cut them in `parts` ranges alike, from a bounded sample by hash; only the balance hangs on it."""
    if parts < 2:
        return []
    if total > 2 * SAMPLED:  # else each task sends the driver as many as it wants in all
        keys = keys.sample(2 * SAMPLED / total, seed=13)
    sample = sorted(tuple(r["key"]) for r in keys.orderBy(F.xxhash64("key")).limit(SAMPLED).select("key").collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _divided(data: list[bytes], cuts: list[tuple]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The parts of a stream between cuts: (number, entries, data); an entry at a cut comes after it."""
    *columns, counts = map(expand, data)
    edges = [0, *(bisect_left(range(len(counts)), cut, key=lambda i: tuple(int(c[i]) for c in columns)) for cut in cuts), len(counts)]
    for k, (i, j) in enumerate(zip(edges, edges[1:])):
        if i < j:
            yield k, j - i, _packed([c[i:j] for c in columns], counts[i:j])


def _dealt(batches: Iterable[pa.RecordBatch], cuts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Pieces by range; one that lies across a cut is divided there."""
    for batch in batches:
        out: list[tuple] = []
        for lang, n, first, last, *data in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "first", "last", *DATA)), strict=True):
            lo, hi = bisect_right(cuts, tuple(first)), bisect_right(cuts, tuple(last))
            if lo == hi:
                out.append((lo, lang, n, *data))
            else:
                out += [(lo + k, lang, m, *part) for k, m, part in _divided(data, cuts[lo:hi])]
        types = [pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * len(DATA)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types, strict=True)], ["range", "lang", "n", *DATA])


def _end_to_end(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """The packed numbers of all rows, `n` in all, each row unpacked into its place."""
    out, at = np.empty(n, np.int64), 0
    for b in column.to_pylist():
        held = expand(b)
        out[at : at + len(held)] = held
        at += len(held)
    return out


def _in_parts(rows: pa.Table, size: int) -> Iterator[pa.Table]:
    """The rows of a range as ranges of about `size` entries, cut by keys that lie evenly in its streams. One of up to half as much again stays whole."""
    sizes = rows.column("n").to_pylist()
    parts = round(sum(sizes) / size)
    if parts < 2:
        yield rows
        return
    step, at, found = max(1, size // 4096), 0, []
    for n, *data in zip(sizes, *(rows.column(c) for c in DATA[:LONGEST]), strict=True):
        found.append([expand(b.as_py())[-at % step :: step] for b in data])
        at += n
    keys = [np.concatenate(c) for c in zip(*found)]
    order = np.lexsort(keys[::-1])
    cuts = sorted({tuple(int(c[order[len(order) * k // parts]]) for c in keys) for k in range(1, parts)})
    out: list[list[tuple]] = [[] for _ in range(len(cuts) + 1)]
    for lang, *data in zip(*(rows.column(c) for c in ("lang", *DATA)), strict=True):
        for k, m, part in _divided([b.as_py() for b in data], cuts):
            out[k].append((lang.as_py(), m, *part))
    types = [pa.string(), pa.int64(), *[pa.binary()] * len(DATA)]
    for held in filter(None, out):
        yield pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], ["lang", "n", *DATA])


def _merged(rows: pa.Table, least: int, size: int) -> pa.Table:
    """Counts of the phrases of a range, about `size` entries at once: however large a range is, a task holds no more of it unpacked."""
    return pa.concat_tables([_counted(part, least) for part in _in_parts(rows, size)])


def _counted(rows: pa.Table, least: int) -> pa.Table:
    """Counts of phrases, from runs of common beginnings. The first and last run of each length may go on next door and are kept whatever they count."""
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    sizes = rows.column("n").to_pylist()
    held = [_end_to_end(rows.column(c), sum(sizes)) for c in DATA]
    word = np.unique(held[0], return_index=True)
    lang_of = np.repeat(coded.indices.to_numpy(), sizes)[word[1]]  # a word is one of its language
    columns, counts = _sorted([c.view(np.uint64) for c in held[:LONGEST]], held[LONGEST])
    del held
    lang = lang_of[np.searchsorted(word[0], columns[0].astype(np.int64))]
    n, new = len(counts), np.zeros(len(counts), bool)
    new[:1] = True
    kinds, found, total = [], [], []
    for k in range(LONGEST):
        new[1:] |= columns[k][1:] != columns[k][:-1]
        if k == 0:
            continue
        at = np.flatnonzero(new)
        sums = np.add.reduceat(counts, at) if n else counts
        edge = np.zeros(len(at), bool)
        edge[:1] = edge[-1:] = True
        wanted = (columns[k][at] > 0) & ((sums >= least) | edge)
        at, sums = at[wanted], sums[wanted]
        kinds.append(lang[at])
        found.append(pa.FixedSizeListArray.from_arrays(pa.array(np.stack([c[at] for c in columns[: k + 1]], 1).ravel().astype(np.int64)), k + 1).cast(pa.list_(pa.int64())))
        total.append(sums)
    pa.default_memory_pool().release_unused()
    return pa.table({"lang": coded.dictionary.take(pa.array(np.concatenate(kinds))), "words": pa.concat_arrays(found), "f": pa.array(np.concatenate(total).astype(np.int64))})


def phrase_counts(docs: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, words, f) of phrases of one to five words met `least` times, the dictionary (lang, id, word), and (lang, n).

    Words are those of `mine`; `words` holds ids of the dictionary, which has the words met `least` times.
    """
    parts = bucket_count(docs)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(lambda it: _blocks(it, parts), BLOCKS), "phrase-blocks")
    totals = blocks.filter("seq is not null").select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    coded = stored(numbered(blocks.filter("bucket is not null").select("block", "bucket", "places", "names", "counts"), parts, least), "phrase-words")
    tagged = F.col("name").cast("string")
    dictionary = known_words(coded).select(F.expr("substring(cast(name as string), locate(' ', cast(name as string)) + 1)").alias("lang"), "id", F.substring_index(tagged, " ", 1).alias("word"), "count")
    seqs = blocks.filter("seq is not null").select("block", "langs", "of", "seq")
    back = coded.filter("block is not null").select("block", "places", "ids")
    size = RANGE
    step = max(1, size // KEYS)
    pieces = stored(seqs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda b, k: _pieces(b, k, step), PIECES), "phrase-streams")
    entries = pieces.agg(F.sum("n")).first()[0] or 0
    cuts = _ranges(pieces.select(F.explode("keys").alias("key")), entries / step, -(-entries // size))
    dealt = pieces.drop("keys").mapInArrow(lambda it: _dealt(it, cuts), "range int, lang string, n long, " + ", ".join(f"{c} binary" for c in DATA))
    counted = dealt.groupBy("range").applyInArrow(lambda t: _merged(t, least, size), "lang string, words array<long>, f long")
    counted = counted.groupBy("lang", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    single = dictionary.select("lang", F.array("id").alias("words"), F.col("count").alias("f"))
    return stored(single.unionByName(counted), "phrase-counts"), dictionary.select("lang", "id", "word"), totals


def _spread(batches: Iterable[pa.RecordBatch], cuts: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    """Phrases by range of their order; one that others go on from stands, carried, in every range that they reach."""
    for batch in batches:
        out: list[tuple] = []
        for lang, words_, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = tuple(reversed(words_) if last else words_)
            lo, hi = bisect_right(cuts, key), bisect_left(cuts, (*key, 1 << 62))
            out += [(last, b, lang, list(key), f, b > lo) for b in range(lo, hi + 1)]
        types = [pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types, strict=True)], ["last", "range", "lang", "key", "f", "carried"])


def _scanned(rows: pa.Table) -> pa.Table:
    """One pass over a sorted range: the counts of each phrase's beginnings, and its most frequent extension in this range."""
    key, f, carried = rows.column("key").combine_chunks(), rows.column("f").to_numpy(), rows.column("carried").to_numpy()
    depth = pc.list_value_length(key).to_numpy().astype(np.int64)
    flat, starts = pc.list_flatten(key).to_numpy(), np.cumsum(depth) - depth
    columns = [np.where(depth > j, flat[np.minimum(starts + j, len(flat) - 1)], 0) for j in range(LONGEST)]
    order = np.lexsort(columns[::-1])
    f, depth, carried, n = f[order], depth[order], carried[order], len(order)
    back = order  # place of each sorted row in the table
    before = []  # for each depth, the last row of that depth up to here
    for d in range(1, LONGEST):
        before.append(np.maximum.accumulate(np.where(depth == d, np.arange(n), -1)))
    more = np.zeros(n, np.int64)
    for d in range(2, LONGEST + 1):
        some = np.flatnonzero(depth == d)
        np.maximum.at(more, before[d - 2][some], f[some])
    counts = np.stack([f[np.maximum(b, 0)] for b in before], 1)
    taken = np.arange(LONGEST - 1)[None, :] < (depth - 1)[:, None]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth - 1)]), pa.int32()), pa.array(counts[taken]))
    lists = pc.if_else(pa.array(~carried), lists, pa.scalar(None, lists.type))
    rows = rows.take(pa.array(back))
    return pa.table({"last": rows.column("last"), "lang": rows.column("lang"), "key": rows.column("key"), "f": rows.column("f"), "counts": lists, "more": pa.array(more)})


def surroundings(counts: DataFrame) -> DataFrame:
    """(lang, words, f, firsts, lasts, more): for each phrase the counts of its beginnings and endings by length, and of its most frequent extension by a word."""
    total = counts.count()
    sides = []
    for last in (False, True):
        key = F.reverse("words") if last else F.col("words")
        cuts = _ranges(counts.select(key.alias("key")), total, -(-total // SCANNED))
        spread = counts.select("lang", "words", "f").mapInArrow(lambda it, c=cuts, z=last: _spread(it, c, z), "last boolean, range int, lang string, key array<long>, f long, carried boolean")
        sides.append(spread)
    passed = sides[0].unionByName(sides[1]).groupBy("last", "range").applyInArrow(_scanned, "last boolean, lang string, key array<long>, f long, counts array<long>, more long")
    passed = passed.filter(F.size("key") > 1).withColumn("words", F.when(F.col("last"), F.reverse("key")).otherwise(F.col("key")))
    firsts, lasts = (F.max(F.when(F.col("last") == z, F.col("counts"))) for z in (False, True))
    return passed.groupBy("lang", "words").agg(F.max("f").alias("f"), firsts.alias("firsts"), lasts.alias("lasts"), F.max("more").alias("more"))


def mine(docs: DataFrame, *, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the `top` phrases of two to five words by score.

    A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words at blanks and tabs. Null texts are
    empty, a null language is `und`. a, l and r count a phrase and the two parts of its lowest-scoring
    cut (of equal ones the first), n all words of the language; score is floor(1000 a n / (l r)).
    Phrases are met `least` times at least; one that a longer phrase of equal count contains is left
    out. Ranks go by score and count downwards, then by the phrase's bytes. Repeated rows count each;
    other columns are ignored; no text gives no rows.
    """
    counts, dictionary, totals = phrase_counts(docs, least, text_col=text_col, lang_col=lang_col)
    salts = 16
    n = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = surroundings(counts).filter("more < f").withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(salts)).cast("int")).join(n, ["lang", "salt"])

    def exact(column: Column) -> Column:
        return column.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.get("firsts", k - 1), F.get("lasts", F.size("words") - k - 1)
        over = F.call_function("div", (exact(F.col("f")) * exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), exact(left) * exact(right))
        return F.struct(over.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    found = found.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)))
    found = found.select("lang", "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("words"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a")]
    found = stored(found.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("at") <= top).drop("at"), "phrases")
    named = found.select("lang", "words", F.posexplode("words").alias("pos", "id")).join(dictionary.select("id", "word"), "id")
    named = named.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = found.join(named, ["lang", "words"])
    for part in (["lang", "salt"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(len(w))) AS i FROM w),
g AS (SELECT lang, w[i + 1 : i + m] AS p FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m <= len(w)),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY 1),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2 AND f >= 100),
inner_ AS (SELECT lang, p[i + 1 : i + m] AS p, max(a) AS longest FROM (SELECT lang, p, a, m, unnest(range(len(p) - m + 1)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < len(p)) GROUP BY 1, 2),
k AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM c),
v AS (SELECT k.lang, k.p, k.a, k.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN n ON n.lang = k.lang JOIN f l ON l.lang = k.lang AND l.p = k.p[1 : k.k] JOIN f r ON r.lang = k.lang AND r.p = k.p[k.k + 1 :]),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase, b.a, l, r, n, score
FROM b LEFT JOIN inner_ ON inner_.lang = b.lang AND inner_.p = b.p WHERE coalesce(longest, 0) < b.a QUALIFY rank <= 2000
"""

"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.components import components
from siltlog.llm.shared import stored

#: Values of a signature, orders (trees) over it, and the values that a region shares at least.
VALUES, TREES, DEPTH = 128, 32, 4
#: Regions up to this size are compared in full at once, larger ones by sorted neighbours first.
SMALL = 8
#: Chance at most that a pair of just the wanted similarity agrees in too few values to be checked.
MISSED = 1e-6
#: Regions of more members, or of more shingles, are dealt to parts; each part of rows meets each part of columns.
LARGE, LARGE_SHINGLES = 2048, 4_000_000
#: Values in each further order for members of crowded regions, drawn from DEEP_VALUES; a depth that needs over MOST_TREES orders is left out.
DEEPER, DEEP_VALUES, MOST_TREES = (8, 12), 1024, 1000
#: Document ids are sent to every executor up to this many (8 bytes each), else both sides are shuffled.
SENT_IDS = 1_000_000

_RANDOM = np.random.default_rng(7)
_FACTOR = (_RANDOM.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_SHIFT = _RANDOM.integers(0, 2**32, VALUES, dtype=np.uint32)
_DEEP_FACTOR = (_RANDOM.integers(0, 2**31, DEEP_VALUES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_DEEP_SHIFT = _RANDOM.integers(0, 2**32, DEEP_VALUES, dtype=np.uint32)


def signature(shingles: np.ndarray, factor: np.ndarray = _FACTOR, shift: np.ndarray = _SHIFT) -> np.ndarray:
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 2**32 - 1, np.uint32)
    for at in range(0, len(keys), 2048):
        np.minimum(least, (keys[at : at + 2048, None] * factor + shift).min(axis=0), out=least)
    return least


def _described(batches: Iterable[pa.RecordBatch], size: int, seed: int = 0) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column(1)):
            counts, digests, signatures = [], [], []
            for s in words.shingles(*words.word_hashes(texts, seed=seed), size):
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n_shingles", "digest", "signature"])


def _sets(batches: Iterable[pa.RecordBatch], size: int, seed: int = 0) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column(1)):
            sets = pa.array([s.tobytes() for s in words.shingles(*words.word_hashes(texts, seed=seed), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), sets], ["id", "shingles"])


def _linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _regions(nodes: DataFrame) -> DataFrame:
    """(key, part, node, n, rest): members of each prefix of DEPTH values that two or more signatures share in a tree.

    A tree reads the signature from its own place on, round the end. A region of more than LARGE
    members is dealt to parts, in each tree differently, for the sorted order only.
    """
    round_ = F.concat("signature", "signature")
    start = F.col("tree") * (4 * VALUES // TREES) + 1
    trees = F.array(*[F.xxhash64(F.lit(DEPTH), F.lit(t), round_.substr(F.lit(t * (4 * VALUES // TREES) + 1), F.lit(4 * DEPTH))) for t in range(TREES)])
    entries = nodes.select("node", F.posexplode(trees).alias("tree", "key"))
    counts = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    found = stored(entries.join(counts, "key"), "regions")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / LARGE))
    rest = round_.substr(start + 4 * DEPTH, F.lit(80))
    return stored(found.join(nodes, "node").select("key", part.alias("part"), "node", "n", rest.alias("rest")), "forest")


def _candidates(regions: DataFrame) -> DataFrame:
    """Pairs of all members of small regions, and of neighbours in the sorted order of larger ones."""
    order = Window.partitionBy("key", "part").orderBy("rest", "node")
    near = F.array(
        F.lead("node", 1).over(order),
        *[F.when(F.col("n") <= SMALL, F.lead("node", k).over(order)) for k in range(2, SMALL)],
        F.when(F.col("n") > SMALL, F.first("node").over(order)),
    )
    pairs = regions.select("node", near.alias("near")).select("node", F.explode(F.filter("near", lambda x: x.isNotNull())).alias("with")).filter("node <> with")
    return pairs.select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()


def _agreement(percent: int) -> int:
    """The values that two signatures must share at least for an exact check."""
    p, total, least = percent / 100, 0.0, 0
    while least < VALUES:
        total += comb(VALUES, least) * p**least * (1 - p) ** (VALUES - least)
        if total > MISSED:
            break
        least += 1
    return least


def _by_region(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows and columns of each region in a block that has both."""
    key, is_row = block["key"].to_numpy(), block["is_row"].to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        rows, columns = members[is_row[members]], members[~is_row[members]]
        if len(rows) and len(columns):
            yield rows, columns


def _may_link(component: np.ndarray, size: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """Which rows and columns are of two components and of sizes that a link allows."""
    small, large = np.minimum(size[rows][:, None], size[columns]), np.maximum(size[rows][:, None], size[columns])
    return (component[rows][:, None] != component[columns]) & (100 * small >= percent * large)


def _active(block: pa.Table, least: int, percent: int) -> pa.Table:
    """The rows and columns of a block that have a partner of another component with `least` values in common."""
    block = block.combine_chunks()
    component, size = block["component"].combine_chunks().dictionary_encode().indices.to_numpy(), block["n_shingles"].to_numpy()
    sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(-1, VALUES)
    chosen = np.zeros(block.num_rows, bool)
    for rows, columns in _by_region(block):
        across = np.ascontiguousarray(sketch[columns].T)
        step = max(1, (1 << 20) // len(columns))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            same, down = np.zeros((len(some), len(columns)), np.uint8), np.ascontiguousarray(sketch[some].T)
            for k in range(VALUES):
                same += down[k][:, None] == across[k]
            good = (same >= least) & _may_link(component, size, some, columns, percent)
            chosen[some] |= good.any(axis=1)
            chosen[columns] |= good.any(axis=0)
    out = block.select(["single", "block", "r", "c", "key", "node", "is_row"]).append_column("component", pa.array(component, pa.int32()))
    return out.filter(pa.array(chosen))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `left` with each of `right`, sets of distinct numbers."""
    values, which = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    n = sum(map(len, left))
    row, column = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    in_left, in_right = which[:n], which[n:]
    a, b = np.bincount(in_left, minlength=len(values)), np.bincount(in_right, minlength=len(values))
    out = np.zeros((len(left), len(right)), np.int32)
    # values that many have are compared as bits, others by listing who has them
    often = a * b * 64 > len(left) * len(right)
    number = np.cumsum(often) - 1
    for at in range(0, int(often.sum()), 64):
        bits = []
        for of, who, size in ((in_left, row, len(left)), (in_right, column, len(right))):
            some = often[of] & (number[of] >= at) & (number[of] < at + 64)
            held = np.zeros(size, np.uint64)
            np.bitwise_or.at(held, who[some], np.uint64(1) << (number[of[some]] - at).astype(np.uint64))
            bits.append(held)
        out += np.bitwise_count(bits[0][:, None] & bits[1])
    rare = np.flatnonzero(~often & (a > 0) & (b > 0))
    if len(rare):
        by_left, by_right = np.argsort(in_left, kind="stable"), np.argsort(in_right, kind="stable")
        start_left, start_right = np.cumsum(a) - a, np.cumsum(b) - b
        for some in np.array_split(rare, 1 + int((a[rare] * b[rare]).sum()) // 2_000_000):
            pairs = a[some] * b[some]
            k = words.gather(np.arange(int(pairs.max(initial=0))), np.zeros(len(some), np.int64), pairs)
            at = np.repeat(np.arange(len(some)), pairs)
            i = row[by_left[start_left[some][at] + k // b[some][at]]]
            j = column[by_right[start_right[some][at] + k % b[some][at]]]
            out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    return out


def _tied(block: pa.Table, percent: int) -> pa.Table:
    """(a, b): a spanning forest of the links between the rows and columns of each region of a block, on full sets."""
    block = block.combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"].combine_chunks()]
    size, component = np.array([len(x) for x in sets], np.int64), block["component"].to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, columns in _by_region(block):
        both = _common([sets[k] for k in rows], [sets[k] for k in columns]).astype(np.int64)
        linked = (100 * both >= percent * (size[rows][:, None] + size[columns] - both)) & _may_link(component, size, rows, columns, percent)
        down, across = np.arange(len(rows)), np.full(len(columns), len(rows))
        while True:  # the smallest row that links reach
            across = np.where(linked, down[:, None], across).min(axis=0, initial=len(rows))
            after = np.minimum(down, np.where(linked, across, len(rows)).min(axis=1, initial=len(rows)))
            if (after == down).all():
                break
            down = after
        moved, met = np.flatnonzero(down != np.arange(len(rows))), np.flatnonzero(across < len(rows))
        left += [rows[moved], columns[met]]
        right += [rows[down[moved]], rows[across[met]]]
    nodes = block["node"]
    return pa.table({"a": nodes.take(pa.array(np.concatenate(left))), "b": nodes.take(pa.array(np.concatenate(right)))})


def _orders_needed(depth: int, percent: int) -> int | None:
    """Orders of `depth` random values in which a pair of just `percent` meets, but for a chance of MISSED; None above MOST_TREES."""
    p, every = percent / 100, range(DEEP_VALUES + 1)
    equal = np.array([comb(DEEP_VALUES, m) * p**m * (1 - p) ** (DEEP_VALUES - m) for m in every])
    apart = 1 - np.array([comb(m, depth) / comb(DEEP_VALUES, depth) for m in every])
    return next((n for n in range(1, MOST_TREES + 1) if (equal * apart**n).sum() <= MISSED), None)


def _deep_keys(batches: Iterable[pa.RecordBatch], depth: int, orders: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(depth)
    chosen = np.array([rng.choice(DEEP_VALUES, depth, replace=False) for _ in range(orders)])
    factor = rng.integers(0, 2**63, (orders, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            keys = [((signature(np.frombuffer(s.as_buffer(), np.uint64), _DEEP_FACTOR, _DEEP_SHIFT)[chosen].astype(np.uint64) + np.uint64(1)) * factor).sum(axis=1) for s in some.column(1)]
            ends = pa.array(np.arange(some.num_rows + 1) * orders, pa.int32())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))], ["node", "keys"])


def _deeper(crowded: DataFrame, sets: DataFrame, depth: int, orders: int) -> DataFrame:
    """(key, node): each node once in each of `orders` orders; nodes of a key share `depth` values."""
    kind = crowded.schema["node"].dataType.simpleString()
    full = crowded.join(sets.select(F.col("id").alias("node"), "shingles"), "node")
    keys = full.select("node", "shingles").mapInArrow(lambda it: _deep_keys(it, depth, orders), f"node {kind}, keys array<long>")
    return stored(keys.select(F.explode("keys").alias("key"), "node"), "deeper")


def _crossing(regions: DataFrame, sketches: DataFrame, sets: DataFrame, label: DataFrame | None, percent: int, depths: tuple[int, ...] = ()) -> DataFrame:
    """(a, b): links between members of a region whose components differ, as a spanning forest of each block.

    Regions that one block can hold are compared as they are. Members of crowded ones go on to orders
    of the next of `depths`, so many that a pair of just the wanted similarity meets in one, but for
    a chance of MISSED. What is still crowded at the last depth is compared in full.
    """
    members, found = regions.filter(F.col("n") > min(SMALL, LARGE)).select("key", "node"), None
    for depth in (*depths, None):
        orders = depth and _orders_needed(depth, percent)
        if depth and not orders:
            continue
        links, crowded = _compared(members, sketches, sets, label, percent, whole=depth is None)
        found = links if found is None else found.unionByName(links)
        if crowded is None:
            break
        members = _deeper(crowded, sets, depth, orders)
    return found


def _compared(members: DataFrame, sketches: DataFrame, sets: DataFrame, label: DataFrame | None, percent: int, *, whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) across the components of each region, and the nodes of regions left out as crowded, if any.

    Members outside a region's most frequent component are rows, all members are columns. Both are dealt
    to parts, and each part of rows meets each part of columns; small regions share a block. Members
    whose sketches agree with no partner of another component leave before the full sets come in.
    A region is crowded if its rows and columns have more pairs than a block; none is if `whole`.
    """
    kind, least = members.schema["node"].dataType.simpleString(), _agreement(percent)
    of = sketches.select("node", "n_shingles")
    if label is None:
        of = of.withColumn("component", F.col("node"))
    else:
        of = of.join(label.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = members.join(of, "node")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max(F.struct("c", "component", "s")).alias("main"))
    down = F.greatest((F.col("n") - F.col("main.c")) / LARGE, (F.col("s") - F.col("main.s")) / LARGE_SHINGLES)
    sizes = sizes.filter(F.col("n") > F.col("main.c")).select(
        "key",
        F.col("main.component").alias("main"),
        ((F.col("n") - F.col("main.c")) * F.col("n")).alias("pairs"),
        (2 * F.col("s") - F.col("main.s")).alias("size"),
        F.ceil(down).cast("int").alias("down"),
        F.ceil(F.greatest(F.col("n") / LARGE, F.col("s") / LARGE_SHINGLES)).cast("int").alias("across"),
    )
    sizes, crowded = stored(sizes, "open-regions"), None
    if not whole:
        above = sizes.filter(F.col("pairs") > LARGE * LARGE)
        if above.limit(1).count():
            crowded = stored(members.join(above.select("key"), "key").select("node").distinct(), "crowded")
            sizes = sizes.filter(F.col("pairs") <= LARGE * LARGE)
    single = (F.col("down") == 1) & (F.col("across") == 1)
    bins = max(1, (sizes.filter(single).agg(F.sum("size")).first()[0] or 0) // LARGE_SHINGLES)
    held = members.join(sizes.drop("size", "pairs"), "key").join(sketches.select("node", "sketch"), "node")
    part = F.xxhash64("node", "key")
    columns = held.select("*", F.lit(False).alias("is_row"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("r"), F.pmod(part, F.col("across")).cast("int").alias("c"))
    rows = held.filter(F.col("component") != F.col("main"))
    rows = rows.select("*", F.lit(True).alias("is_row"), F.pmod(part, F.col("down")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("c"))
    both = columns.unionByName(rows).withColumn("single", single).withColumn("block", F.when(single, F.pmod("key", F.lit(bins))).otherwise(F.col("key")))
    blocks = ["single", "block", "r", "c"]
    active = both.groupBy(*blocks).applyInArrow(lambda t: _active(t, least, percent), f"single boolean, block long, r int, c int, key long, node {kind}, is_row boolean, component int")
    full = active.join(sets.select(F.col("id").alias("node"), "shingles"), "node")
    return full.groupBy(*blocks).applyInArrow(lambda t: _tied(t, percent), f"a {kind}, b {kind}"), crowded


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, seed: int = 0) -> DataFrame:
    """(id, n_shingles, digest, signature) per row; the last two are null where the text has no word."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _described(it, size, seed), f"id {kind}, n_shingles long, digest binary, signature binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents of equal shingle sets form a class; signatures of classes stand in TREES sorted orders.
    Members of a region, those that share DEPTH or more leading values, are candidates: all of a small
    region, sorted neighbours of a larger one, confirmed on the full sets. Then members of larger regions
    whose components still differ are compared, first by signature, and on the full sets where enough
    values agree; depth follows crowding, as members of a crowded region are dealt to many orders of
    DEEPER values, and compared in full where the last of these are still crowded. Each component is
    found, not every link within one.

    Null or blank texts have no shingle, link with nothing and are kept. A null id stays a row of
    its own: its text can give no component an id, so it links with nothing. Rows that repeat an id
    are one document whose texts all count; each row is returned. Other columns are ignored.
    """
    kind, seed = docs.schema[id_col].dataType.simpleString(), secrets.randbits(63)  # words cannot be made to collide
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = stored(describe(rows, id_col="id", size=size, seed=seed), "described")
    classes = known.filter("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    nodes = stored(classes, "classes")
    regions = _regions(nodes.select("node", "signature"))
    wanted = regions.select(F.col("node").alias("id")).distinct()
    n = wanted.count()
    texts = rows.join(F.broadcast(wanted) if n <= SENT_IDS else wanted, "id", "left_semi")
    sets = stored(texts.mapInArrow(lambda it: _sets(it, size, seed), f"id {kind}, shingles binary"), "sets")
    same = known.filter("digest is not null").join(nodes.select("digest", "node"), "digest").filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    twice = known.filter("digest is not null").groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("id")

    # the low byte of each value: unequal values share it by chance at times, equal ones always
    low = F.concat(*[F.substring("signature", 4 * k + 4, 1) for k in range(VALUES)])
    sketches = stored(nodes.join(wanted.withColumnRenamed("id", "node"), "node", "left_semi").select("node", "n_shingles", low.alias("sketch")), "sketches")

    pairs = _candidates(regions)
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    links = stored(full.select("a", "b", "x", "y").mapInArrow(lambda it: _linked(it, percent), f"a {kind}, b {kind}"), "links")
    label = components(links)
    more = stored(_crossing(regions, sketches, sets, label, percent, DEEPER), "crossing")
    if more.limit(1).count():
        links = links.unionByName(more)
        label = components(links)
    # rows that repeat an id tie the classes of their texts together
    if twice.limit(1).count():
        label = components(links.unionByName(same.join(twice.withColumnRenamed("id", "a"), "a", "left_semi")))

    out = known.join(nodes.select("digest", "node"), "digest", "left")
    out = out.withColumn("node", F.when(F.col("id").isNotNull(), F.col("node")))
    out = out.join(label.withColumnRenamed("id", "node"), "node", "left")
    out = out.withColumn("component_id", F.coalesce("component", "node", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

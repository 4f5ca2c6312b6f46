import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from siltlog.llm import bpe, brown, lines, neardup, quality, registry, rules, urls, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    assert rows_of(registry.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(registry.ORACLE[name]).df())


def test_words_and_shingles(monkeypatch):
    texts = ["", None, "a", " A b\tc\n", "É é x\u00a0y", "a b c d e a b c d e f"]
    hashes, rows = words.word_hashes(pa.array(texts))
    found = [WORD.findall((t or "").translate(LOW)) for t in texts]
    assert [len(f) for f in found] == [b - a for a, b in zip(rows, rows[1:])]
    names = {}
    for h, w in zip(hashes.tolist(), (w for f in found for w in f), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert [len(s) for s in words.shingles(hashes, rows)] == [0, 0, 1, 1, 1, 6]
    again, _ = words.word_hashes(pa.array(["zz", *texts])[1:])
    assert again.tolist() == hashes.tolist()  # a slice of a column
    monkeypatch.setattr(words, "PART", 3)
    again, ends = words.word_hashes(pa.array(texts))
    assert again.tolist() == hashes.tolist() and ends.tolist() == rows.tolist()


def thue_morse(n, a="a", b="b"):
    text, other = a, {a: b, b: a}
    while len(text) < n:
        text += "".join(other[c] for c in text)
    return text


def test_words_that_rolling_sums_confuse(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    assert len(set(words.word_hashes(pa.array([f"{x} {y}", x + y, y + x]))[0].tolist())) == 4
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["n_known"] for r in brown.score(docs, classes=5, parts=3, part=zlib.crc32(b"2") % 3).collect()} == {1: 2, 2: 1, 3: 2}


def test_url_filter(spark):
    rows = ["http://A.Example.ORG/en/1?x", "https://example.org", "x://b.com/de/", None, "", "no scheme/en/1", "http://org/", "http://xorg/", "http://a.b.com/fr/?://c.org/", "s://example.org/en/12#y", "s://q?/a", "ftp://é.org/ö/\nz"]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(rows)], "page_id long, url string, host int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.OP2_RULES).collect()}
    assert got[0] == ("a.example.org", "/en/1", "example.org/en/1", "block") and got[1] == ("example.org", "", None, "allow")
    assert got[2][2:] == ("com/de/", "block") and got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/", "allow") and got[7][2] is None and got[8] == ("a.b.com", "/fr/", "com/fr/", "allow")
    assert got[9][2:] == ("example.org/en/1", "block") and got[10][:2] == ("q", "") and got[11][:3] == ("é.org", "/ö/\nz", "org/")
    assert urls.judge_urls(df, [], default="block").filter("verdict = 'block'").count() == len(rows)
    assert urls.judge_urls(df.limit(0), urls.OP2_RULES).count() == 0
    far = ["x://" + "a." * 50_000 + "org/", "x://" + "a" * 300 + ".com/de/", "x://.com/de/", "x://com./de/"]
    again = spark.createDataFrame([(1, far[0]), (1, far[0]), (None, far[1]), (2, far[2]), (3, far[3])], "page_id long, url string")
    assert sorted(map(str, ((r["page_id"], r["rule"]) for r in urls.judge_urls(again, urls.OP2_RULES).collect()))) == ["(1, 'org/')", "(1, 'org/')", "(2, 'com/de/')", "(3, None)", "(None, 'com/de/')"]


def test_digest_collisions_are_told_apart(tmp_path):
    path = str(tmp_path / "rules")
    urls.build([("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "b.com", "/")], path)
    rules_ = urls.Rules(path)
    rules_.digests = rules_.digests.copy()
    rules_.digests[:] = rules_.digests[0]  # as if all digests were one
    real, urls._digest = urls._digest, lambda h, p: int(rules_.digests[0])
    try:
        assert rules_.judge(["a.com", "b.com", "c.com"], ["/x", "/x", "/x"], "none") == (["a.com/x", "b.com/", None], ["allow", "block", "none"])
    finally:
        urls._digest = real


def test_rules_on_odd_rows(spark, duck):
    repeat = "one two three four five six seven eight nine ten "
    texts = [None, "", " \t\n", "a " * 30, repeat * 2, repeat + "x " + repeat, "the cat\nthe cat\n\n \nThe cat", "#" * 5 + " é漢 *", "a\u00a0b\x1cc", "w " + "x" * 100_000]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] + [(None, "x", 9), (3, "y", 9)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in rules.judge(df).filter("doc_id is not null").collect() if r["n_words"] != 1 or r["doc_id"] != 3}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        held = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(held) - len(set(held)), len(hit))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert rules.judge(df).count() == len(texts) + 2 and rules.judge(df.limit(0)).count() == 0


LINE = "This line is long enough to be a key, it has over forty characters"


def test_lines_on_odd_rows(spark):
    rows = [(k, f" {LINE.upper() if k % 2 else LINE}\t\nown {k}\n{LINE}", k) for k in range(6)]
    rows += [(6, None, 6), (7, "", 7), (8, "short\nshort", 8), (None, LINE, 9), (9, "x" * 30_000 + "\n", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys int")
    got = {r["doc_id"]: r for r in lines.drop_shared_lines(df).collect()}
    assert all(got[k]["text"] == f"own {k}" and got[k]["n_dropped"] == 2 for k in range(5)) and got[5]["text"] == rows[5][1]
    assert got[6]["text"] == got[7]["text"] == "" and got[6]["n_lines"] == 1 and got[8]["n_dropped"] == 0 and got[None]["text"] == "" and got[9]["n_lines"] == 2
    assert got[3]["keys"] == 3 and lines.drop_shared_lines(df.limit(0)).count() == 0
    assert lines.drop_shared_lines(df, least_docs=8).agg({"n_dropped": "sum"}).first()[0] == 0


def test_runs_hold_each_key_once(spark):
    runs = lines.LineRuns(spark, fan=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, b * 10 + k) for k in range(b, b + 3)] + [(99, 99, b)], "h1 long, h2 long, id long"))
    known = runs._union(runs._all()).filter("fresh")
    assert known.count() == known.select("h1").distinct().count() == 8 and len(runs.levels[0]) < 2
    assert {r["h1"]: r["keeper"] for r in runs.shared(3).collect()} == {2: 22, 3: 33, 4: 44, 99: 4}
    runs.close()


def test_runs_are_merged_as_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(lines.ORDERED, "true")
    try:
        runs = lines.LineRuns(spark)
        for b in range(2):
            runs.add(spark.range(b * 50, 1000).selectExpr("xxhash64(id) h1", "hash(id) h2", "id"))
        one, two = (spark.table(t) for t in runs._all())
        assert one.filter("fresh").count() == 1000 and two.filter("fresh").count() == 0
        plan = two.join(one, lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        runs.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(lines.ORDERED)


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [None, "", "a", "  two  spaces \n\n\n end ", "don't 123 ÉÈ 漢字😀", "<|endoftext|>", "\x00\x1c\u00a0\u2028", "x" * 20_000, "the the the", "the the the"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "the", 1), (2, "a", 1)], "doc_id long, text string, block int").repartition(3)
    out = bpe.encode(df, path, public_tokenizers.PATTERN, buckets=4)
    got = {}
    for r in out.withColumn("bytes", bpe.decode(out["tokens"], path)).collect():
        got.setdefault(r["doc_id"], []).append((r["tokens"], bytes(r["bytes"])))
    for k, t in enumerate(texts):
        assert got[k][0] == (encoder.encode_ordinary(t or ""), (t or "").encode())
    again = bpe.encode(df, path, public_tokenizers.PATTERN, decoded=True)
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in again.collect()) == sorted((k or -1, b) for k, rows in got.items() for _, b in rows)
    assert len(got[2]) == 2 and got[None][0][1] == b"the" and bpe.encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_long_texts_in_runs(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["it's  a   long\n\n text 12345 \t end " * 40_000, "don't  stop  " * 9, "a b\n" + " " * 3000, ""]
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN, buckets=3, decoded=True).collect()}
    for k, t in enumerate(texts):
        assert got[k]["tokens"] == encoder.encode_ordinary(t) and bytes(got[k]["decoded"]) == t.encode()


def test_byte_bpe_query_on_all_documents(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in bpe.op5_byte_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for doc, text in rows:
        ids = encoder.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert tuple(got[doc][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def brute(texts, percent=75):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op6_minhash_dedup(spark, sf).collect()}
    assert got == brute(texts)


def test_near_duplicates_in_a_crowd(spark):
    import random

    rng, texts = random.Random(3), {}
    base = [f"w{k}" for k in range(60)]
    for k in range(150):  # a crowded region: one or two words changed anywhere
        w = list(base)
        for _ in range(rng.choice((1, 2))):
            w[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts[k] = " ".join(w)
    texts |= {200: None, 201: " \n", 202: "one two", 203: "One  TWO", 204: "one", 205: " ".join(base), 206: " ".join(base).upper(), 207: "x " * 30_000}
    df = spark.createDataFrame([(k, t, "c") for k, t in texts.items()] + [(None, "one two", "c"), (202, "one two", "c")], "doc_id long, text string, node string")
    rows = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == brute(texts)
    assert len(rows) == len(texts) + 2 and all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in rows)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_copies_that_only_their_original_ties(spark):
    import random

    rng, base = random.Random(5), [f"w{k}" for k in range(240)]
    texts = {150: " ".join(base)}
    for k in range(301):  # each near the original, most of them not near each other
        if k != 150:
            w = list(base)
            for at in rng.sample(range(48), 5):
                w[at * 5] = f"v{k}x{at}"
            texts[k] = " ".join(w)
    want = brute(texts)
    assert {c for _, c in want.values()} == {0}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_regions_split_and_stay_tied(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 6)
    base = [f"w{k}" for k in range(50)]
    texts = {k: " ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(40)}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts)


def test_blocks_of_a_region_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 16)
    # one region in the first tree; 40 pairs share three values of four, so no longer prefix than that
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**32, (200, neardup.VALUES), np.uint32)
    values[:, :4] = 7
    share = np.arange(neardup.VALUES) % 4 != 3
    share[:4] = True
    for k in range(40):
        values[2 * k + 1, share] = values[2 * k, share]
    nodes = spark.createDataFrame([(k, 50, v.astype(">u4").tobytes()) for k, v in enumerate(values)], "node long, n_shingles long, signature binary")
    regions = neardup._regions(nodes.select("node", "signature"))
    assert {(r["key"], r["n"]) for r in regions.collect()} == {(regions.first()["key"], 200)} and regions.count() == 200
    low = [(k, 50, v.astype(np.uint8).tobytes()) for k, v in enumerate(values)]
    sketches = spark.createDataFrame(low, "node long, n_shingles long, sketch binary")
    own = [(k, np.sort(np.append(np.arange(44) + 100 * (k // 2), 10**6 + k * 10 + np.arange(6))).astype(np.uint64).tobytes()) for k in range(200)]
    links = neardup._crossing(regions, sketches, spark.createDataFrame(own, "id long, shingles binary"), None, 75).collect()
    assert {(min(r), max(r)) for r in links} == {(2 * k, 2 * k + 1) for k in range(40)}


def test_common_counts():
    rng = np.random.default_rng(3)
    for high in (30, 400, 20_000):
        left, right = ([np.unique(rng.integers(0, high, rng.integers(0, 60))).astype(np.uint64) for _ in range(n)] for n in (37, 52))
        got = neardup._common(left, right)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(left) for j, b in enumerate(right))


def test_near_duplicates_that_share_a_template(spark, monkeypatch):
    """Every document has one near copy; all others share the template, just below the threshold."""
    import random

    for same, large in ((9, 2048), (14, 300)):  # similarities of 0.764 and 0.787; all other pairs have 0.725
        monkeypatch.setattr(neardup, "LARGE", large)
        rng, texts = random.Random(same), {}
        template = [f"t{k}" for k in range(300)]
        for k in range(600):
            tail = [f"d{k}x{i}" for i in range(56)]
            copy = [*tail[:same], *(f"e{k}x{i}" for i in range(56 - same))]
            texts[2 * k], texts[2 * k + 1] = " ".join(template + tail), " ".join(template + copy)
        order = list(texts.items())
        rng.shuffle(order)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        found = sum(got[2 * k + 1] == got[2 * k] == 2 * k for k in range(600))
        assert found >= 0.99 * 600 and all(c in (k, k - k % 2) for k, c in got.items())


def template_pairs(pairs, template, own, same, seed=0):
    """Texts 2k and 2k + 1 are near copies; all share a template, which alone is below the threshold."""
    import random

    head, texts = [f"t{k}" for k in range(template)], {}
    for k in range(pairs):
        tail = [f"d{k}x{i}" for i in range(own)]
        texts[2 * k] = " ".join(head + tail)
        texts[2 * k + 1] = " ".join([*head, *tail[:same], *(f"e{k}x{i}" for i in range(own - same))])
    order = list(texts.items())
    random.Random(seed).shuffle(order)
    return order


def test_orders_go_deeper_where_regions_are_crowded(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 30)
    seen, compare = [], neardup._compared

    def watched(members, *args, **named):
        links, crowded = compare(members, *args, **named)
        seen.append((named["whole"], crowded is not None))
        return links, crowded

    monkeypatch.setattr(neardup, "_compared", watched)
    order = template_pairs(200, 300, 80, 38)  # similarities of 0.65 and, in pairs, 0.8
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k, _ in order}
    assert seen[0] == (False, True) and seen[-1][1] is False and len(seen) > 1


def test_deeper_orders_bring_every_link_together(spark):
    """Of pairs of just the wanted similarity, none is missed; others at 0.3 hardly meet."""
    rng = np.random.default_rng(2)
    sets, links = [], set()
    common = rng.integers(0, 2**64, 46, np.uint64)
    for k in range(60):
        base = np.concatenate([common, rng.integers(0, 2**64, 40, np.uint64)])
        for j in (0, 1):
            sets.append((2 * k + j, np.unique(np.append(base, rng.integers(0, 2**64, 14, np.uint64))).tobytes()))
        links.add((2 * k, 2 * k + 1))
    df = spark.createDataFrame(sets, "id long, shingles binary")
    for depth in neardup.DEEPER:
        orders = neardup._orders_needed(depth, 75)
        keys = neardup._deeper(df.select(F.col("id").alias("node")), df, depth, orders)
        assert keys.count() == 120 * orders
        two = keys.alias("x").join(keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")))
        met = {tuple(r) for r in two.select("x.node", "y.node").distinct().collect()}
        assert links <= met and len(met) < 120 * 119 / 2 / 5
    assert neardup._orders_needed(8, 20) is None


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x", 0), (2, None, "x", 0), (3, "u\r\nEvil: 1", None, 0), (4, "u", "", 0), (5, "é", "é漢\r\n\r\nWARC/1.1\r\n", 0), (6, "big", "y" * 300_000, 0)], "page_id long, url string, html string, sha int")
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    got = {r["id"]: r for r in warc.read_pages(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {1: ("revisit", 2, 1), 2: ("response", None, 1), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, len("é漢\r\n\r\nWARC/1.1\r\n".encode())), 6: ("response", None, 300_000)}
    assert got[1]["payload_digest"] == got[2]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert bytes(got[5]["payload"]).decode() == "é漢\r\n\r\nWARC/1.1\r\n" and got[3]["target_uri"] == "u  Evil: 1"
    only = spark.read.format("warc").schema("record_id string, record_type string").load(path).filter("record_type = 'revisit'")
    assert {r["record_id"] for r in only.collect()} == {"<urn:page:1>", "<urn:page:3>"} and "revisit" in only._jdf.queryExecution().toString()
    warc.write_pages(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_pages(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_pages(pages, f"file://{tmp_path}/min", least_bytes=1)
    assert warc.read_pages(spark, f"file://{tmp_path}/min").filter("record_type = 'revisit'").count() == 1


def test_warc_spans_and_foreign_files(tmp_path):
    plain = tmp_path / "plain.warc"
    records = [warc.record({"record_id": f"<r{k}>", "record_type": "response", "payload": b"p" * k}) for k in range(50)]
    plain.write_bytes(b"".join(records))
    reader = warc.WarcReader(str(plain), ["record_id", "content_length", "payload"])
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["content_length"] for r in rows] == list(range(50)) and rows[7]["payload"] == b"p" * 7
    warc.SPLIT, old = 500, warc.SPLIT
    try:
        writer = warc.WarcWriter(str(tmp_path / "out"), ["record_id", "payload"])
        writer.commit([writer.write(iter(pa.table({"record_id": [f"<r{k}>" for k in range(60)], "payload": [b"z" * k for k in range(60)]}).to_batches(25)))])
        reader = warc.WarcReader(str(tmp_path / "out"), ["record_id", "payload"])
        assert len(reader.partitions()) > 5
        assert [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [f"<r{k}>" for k in range(60)]
    finally:
        warc.SPLIT = old


def test_warc_appends_add_up(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    one = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (None, "u", "x"), (2, "v", "x"), (None, None, None), (3, "u", "x" * 100_000)], "page_id long, url string, html string")
    warc.write_pages(one, path)
    warc.write_pages(one.filter("page_id = 3").withColumn("page_id", F.lit(9).cast("long")), path)
    got = sorted(((r["id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_pages(spark, path).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (0, "response", None, 1), (0, "response", None, 0), (3, "response", None, 100_000), (9, "response", None, 100_000)], key=str)
    writer = warc.WarcWriter(str(tmp_path / "w"), ["payload"])
    writer.write(iter([]))
    before = len(list((tmp_path / "w").iterdir()))
    writer.abort([None])  # the task's message was lost
    assert len(list((tmp_path / "w").iterdir())) == before - 1


def test_warc_passes_unwanted_payloads_by(tmp_path):
    rng = np.random.default_rng(1)
    noise = [rng.integers(0, 256, 300_000, np.uint8).tobytes() for _ in range(4)]
    made = [warc.record({"record_id": f"<r{k}>", "record_type": "response" if k != 2 else "other", "payload": p}) for k, p in enumerate(noise)]

    def read(path, *fields):
        reader = warc.WarcReader(str(path), ["record_id", *fields])
        assert not list(reader.pushFilters([warc.EqualTo(("record_type",), "response")]))
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    packed, plain, foreign = (tmp_path / n for n in ("a.warc.gz", "b.warc", "c.warc.gz"))
    packed.write_bytes(b"".join(map(warc.member, made)))
    plain.write_bytes(b"".join(made))
    foreign.write_bytes(b"".join(map(gzip.compress, made)))
    assert gzip.decompress(packed.read_bytes()) == b"".join(made)
    for path in (packed, plain, foreign):
        assert [r["record_id"] for r in read(path)] == ["<r0>", "<r1>", "<r3>"]
        assert [r["payload"] for r in read(path, "payload")] == [noise[0], noise[1], noise[3]]
    whole = bytearray(packed.read_bytes())
    ends = np.cumsum([len(warc.member(m)) for m in made])
    whole[ends[2] - 50_000 : ends[2] - 40_000] = bytes(10_000)  # an unwanted payload that cannot be inflated
    packed.write_bytes(whole)
    assert [r["payload"] for r in read(packed, "payload")] == [noise[0], noise[1], noise[3]]
    held = []
    source = warc._Bytes(open(foreign, "rb"), True, 0, -1)
    while (head := source.until(b"\r\n\r\n")) is not None:
        if head.strip():
            source.skip(300_000)
            held.append(len(source.buffer))
    assert len(held) == 4 and max(held) < 200_000  # inflated, but not kept


def test_class_model(spark, sf):
    docs = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(LOW)), "\n"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, t in docs if k not in held for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in brown.op10_class_lm(spark, sf).collect()}
    model = base = 0.0
    for k, t in docs:
        r = got[k]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in held, len(t), sum(counts[w] > 0 for w in t), n)
        if k not in held:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base


def test_class_model_by_hand(spark):
    """Scores from the classes alone, in plain Python; emissions and transitions are distributions."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).withColumn("block", F.lit(1))
    frame = frame.unionByName(spark.createDataFrame([(900, None, 1), (901, "", 1), (None, "the unheard", 1), (3, "again the", 1)], "doc_id long, text string, block int"), allowMissingColumns=True)
    corpus = brown.number(frame, buckets=8)
    label = brown.cluster(corpus, 9)
    kinds = {}
    for r in label.collect():
        kinds |= dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), brown.expand(r["kinds"]).tolist(), strict=True))
    docs = [(r["doc_id"], [int(h) for h in words.word_hashes(pa.array([r["text"]], pa.string()))[0]]) for r in frame.collect()]
    train = [t for k, t in docs if not brown.held_out(k, 7, 2)]
    counts = Counter(h for t in train for h in t)
    assert set(counts) == set(kinds) and set(kinds.values()) <= set(range(1, 9))
    n, distinct = Counter(), Counter(kinds.values())
    for h, c in counts.items():
        n[kinds[h]] += c
    mass, unknown = brown.class_mass(corpus, label, 9)
    assert [tuple(x) for x in mass[1:]] == [(n[k], distinct[k]) for k in range(1, 9)] and distinct[unknown] == max(distinct.values())

    def emission(h):
        k = kinds.get(h, unknown)
        if h not in counts:
            return k, 0.5 * distinct[k] / n[k]
        return k, (counts[h] - (0.5 if k == unknown else 0)) / n[k]

    for k in n:
        assert sum(emission(h)[1] for h in counts if kinds[h] == k) + (emission(-1)[1] if k == unknown else 0) == pytest.approx(1)
    steps = Counter()
    for t in train:
        path = [0, *(kinds[h] for h in t), 0]
        steps.update(zip(path, path[1:]))
    step = {(a, b): (steps[a, b] + 0.5) / (sum(steps[a, c] for c in range(9)) + 4.5) for a in range(9) for b in range(9)}
    got = Counter()
    for r in brown._scored(corpus, label, "bigint", 9, 0.5).collect():
        got[r["doc_id" if "doc_id" in r else "id"], r["n_tokens"], round(r["score"], 6)] += 1
    want = Counter()
    for k, t in docs:
        path = [0, *(emission(h)[0] for h in t), 0]
        want[k, len(t) + 1, round(sum(math.log10(step[x]) for x in zip(path, path[1:])) + sum(math.log10(emission(h)[1]) for h in t), 6)] += 1
    assert sum((got - want).values()) <= 1  # rounding at the sixth place


def test_class_model_on_odd_rows(spark):
    texts = ["a b a b c"] * 40 + [None, "", "new words here", "w " * 200_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a", 1), (3, "a b", 1)], "doc_id long, text string, block int")
    got = brown.score(df, classes=10, passes=1).collect()
    assert len(got) == len(texts) + 2 and all(r["score"] <= 0 and r["perplexity"] >= 1 for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 40] == [1] and brown.score(df.limit(0)).count() == 0
    alone = brown.score(df.filter("doc_id = 0"), parts=1, part=0).collect()  # no training text
    assert alone[0]["train_tokens"] == 0 and alone[0]["n_known"] == 0 and alone[0]["score"] == pytest.approx(6 * math.log10(1 / 33))


def test_exchange_finds_classes(spark):
    """Two kinds of words that alternate end up in classes of their own, rare ones too."""
    import random

    rng, one, two = random.Random(1), [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    texts = [" ".join(w for _ in range(15) for w in (rng.choice(one[: 1 + rng.randrange(40)]), rng.choice(two[: 1 + rng.randrange(40)]))) for _ in range(150)]
    corpus = brown.number(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    contexts = {}
    for r in brown.cluster(corpus, 3, passes=3, gain=0.0).collect():
        contexts |= dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), brown.expand(r["kinds"]).tolist(), strict=True))
    hashes = [{int(h) for h in words.word_hashes(pa.array([" ".join(group)]))[0]} for group in (one, two)]
    of = [{contexts[h] for h in group & set(contexts)} for group in hashes]  # the words of training
    assert [len(x) for x in of] == [1, 1] and of[0] != of[1]


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, quality.fit(docs, labels.filter("doc_id % 2 = 0"))).select("doc_id", "kept")
    rows = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.2 * len(junk)


def plain_features(text):
    """Hashed n-grams of a text, one at a time."""
    data, out = (text or "").encode(), Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        out[((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    found = [int(words.word_hashes(pa.array([w]))[0][0]) for w in WORD.findall(text or "")]
    for h in found:
        out[4096 + (h >> 52)] += 1
    for h, after in zip(found, found[1:]):
        out[4096 + (int(words.mix(np.array([(h * 3 + after) % 2**64], np.uint64))[0]) >> 52)] += 1
    size = math.sqrt(sum(math.log(1 + n) ** 2 for n in out.values()))
    return {k: math.log(1 + n) / size for k, n in out.items()}


def test_quality_features(monkeypatch):
    monkeypatch.setattr(words, "PART", 1024)
    texts = ["", None, "a", "ab. é", "The cat! sat on 3 ###\nThe cat! sat on 3 ###", "one two three " * 400]
    (sizes, buckets, values, surface), *more = quality.features(pa.array(texts))
    assert not more
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert dict(zip(buckets[at : at + n].tolist(), values[at : at + n].tolist())) == pytest.approx(plain_features(text))
        at += n
    row = dict(zip(quality.SURFACE, surface[4].tolist()))
    assert row == pytest.approx({"log_words": math.log(13), "symbols": 0.5, "capitals": 2 / 43, "digits": 2 / 43, "shouts": 2 / 12, "stop_words": 4 / 12, "distinct": 0.5, "repeated_lines": 0.5, "word_bytes": 43 / 12, "sentence_ends": 2 / 12})
    assert surface[3][-1] == 1 / 2 and surface[0].tolist() == [0.0] * 10


def test_posteriors_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("site", F.lit(1)).withColumn("row", F.lit(2)).withColumn("__site", F.lit(3))
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 5, "alone").when(F.col("doc_id") % 11 > 0, F.col("source"))).unionByName(docs.filter("doc_id in (1, 2, 3)"))
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = quality.classify(docs, model, without=("text",)).collect()
    assert len(got) == docs.count() and got[0]["__site"] == 3 and "text" not in got[0]

    def groups(key):
        out = {}
        for r in got:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r["doc_score"]
        return out

    def prior(of):
        n, mean = len(got), sum(r["doc_score"] for r in got) / len(got)
        within = mean * (1 - mean)
        spread = (sum(c * (s / c - mean) ** 2 for c, s in of.values()) - (len(of) - 1) * within) / (n - sum(c * c for c, _ in of.values()) / n)
        return mean, min(max(within / spread - 1, 1), 1e6) if spread > 0 else 1e6

    assert sum(r["source"] == "alone" for r in got) == 1
    hosts, paths = groups(lambda r: r["source"]), groups(lambda r: (r["source"], r["lang"]))
    (mean, a), (_, b) = prior(hosts), prior(paths)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    assert None in hosts and len(paths) > len(hosts)
    for r in got:
        (n, s), (m, t) = hosts[r["source"]], paths[r["source"], r["lang"]]
        host = (s - r["doc_score"] + a * mean) / (n - 1 + a)
        path = (t - r["doc_score"] + b * host) / (m - 1 + b)
        odds = logit(r["doc_score"]) + logit(path) - logit(mean)
        assert (r["host_score"], r["path_score"], r["quality"]) == pytest.approx((host, path, 1 / (1 + math.exp(-odds)))) and r["kept"] == (r["quality"] >= 0.5)


def test_groups_above_the_sent_limit_are_salted(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source"))).withColumn("m", F.create_map("lang", "doc_id"))
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    pages = spark.createDataFrame([(k, None if k % 3 else f"u{k}", "" if k % 2 else f"page {k % 10}") for k in range(60)] + [(None, "u", "")], "page_id long, url string, html string")
    got = []
    for sent in (10**6, 0):
        monkeypatch.setattr(quality, "SENT_PATHS", sent)
        monkeypatch.setattr(warc, "SENT_DIGESTS", sent)
        warc.write_pages(pages, str(tmp_path / f"w{sent}"))
        records = warc.read_pages(spark, str(tmp_path / f"w{sent}")).select("id", "target_uri", "record_type", "refers_to")
        judged = quality.classify(docs, model, without=("text", "m")).select("doc_id", F.round("quality", 9), "kept")
        got.append((sorted(map(str, records.collect())), sorted(map(str, judged.collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 61 and len(got[0][1]) == docs.count()


def test_quality_shrinks_sparse_hosts(spark):
    good, bad = "the cat sat on the mat and it was good. ", "### *** $$$ %%% ||| "
    rows = [(k, good, "large", "en", k) for k in range(60)] + [(100 + k, bad, "poor", "en", k) for k in range(60)] + [(200, bad, "tiny", "en", 0), (201, None, None, None, 0), (202, "", "large", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(100 + k, 0, 0) for k in range(30)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, quality.fit(df, labels)).collect()}
    assert got[0]["kept"] and not got[130]["kept"] and len(got) == len(rows)
    assert got[100]["host_score"] < got[200]["host_score"] < got[0]["host_score"]  # one bad page says less than sixty
    empty = quality.fit(df, labels.limit(0))
    assert {round(r["doc_score"], 6) for r in quality.classify(df, empty).collect()} == {0.5} and quality.classify(df.limit(0), empty).count() == 0

"""Operators 11 to 13 and the shared words, against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter
from itertools import groupby, permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from siltlog.llm import dictionary, interactions, passages, phrases, words
from siltlog.llm.blocks import expand, squeeze
from siltlog.llm.packing import WordTokenizer

DOCS = "doc_id long, text string, lang string"
WORDS = r"[^\x20\x09-\x0D]+"


def plain_cut(texts, window):
    """Kept words of each text, by the words' own sequences."""
    held = [re.findall(WORDS, t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in held for i in range(len(w) - window + 1))
    out = []
    for w in held:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def passage_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))
    long = [word() for _ in range(400)]
    texts = [" ".join([word() for _ in range(30)] + long[a : a + n] + [word() for _ in range(20)]) for a, n in ((0, 90), (10, 35), (20, 34), (50, 120), (300, 100), (0, 400))]
    texts += ["a " * 100, "x y " * 40, " ".join(long[:35]), "\t".join(long[:35]), " ".join(long[:34]), None, "", " \n ", "one", " ".join(long[100:140]).upper()]
    return texts + [texts[0], texts[0], " ".join([*long[200:220], "odd", *long[221:260]]), " ".join(long[:50])]


@pytest.mark.parametrize("window,stretch,block", [(35, 1 << 20, 16_000_000), (35, 50, 700), (5, 7, 1), (12, 64, 3000), (1, 40, 500)])
def test_repeated_passages(spark, monkeypatch, window, stretch, block):
    monkeypatch.setattr(passages, "STRETCH", stretch)
    texts = passage_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS).repartition(3)
    seed_block = passages.BLOCK_BYTES
    passages.BLOCK_BYTES = block
    try:
        rows = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in passages.drop_repeats(docs, window=window, buckets=8).collect()}
    finally:
        passages.BLOCK_BYTES = seed_block
    assert rows == dict(enumerate(plain_cut(texts, window)))


def test_stretches_and_blocks_in_the_worker(monkeypatch):
    """Runs of a text cut into short stretches hold the same windows."""
    monkeypatch.setattr(passages, "STRETCH", 13)
    texts = pa.array(passage_texts())
    hashes, rows = words.word_hashes(texts, False, 3)
    held = set()
    for starts, lengths, *_ in passages.runs(hashes, rows, 5):
        held |= {int(s) + k for s, n in zip(starts, lengths, strict=True) for k in range(int(n))}
    assert held == {int(a) + i for a, b in zip(rows[:-1], rows[1:], strict=True) for i in range(int(b - a) - 4)}


def test_passages_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text, 1), (7, text, 2), (7, text + " tail", 3), (None, None, 4)], "doc_id long, text string, n_words int")
    got = sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in passages.drop_repeats(docs).collect())
    assert got == [("7", "", 40, 40), ("7", "tail", 41, 40), ("None", "", 0, 0), ("None", "", 40, 40)]
    assert passages.drop_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        passages.drop_repeats(docs, window=65)


def test_a_long_text(spark):
    part = " ".join(f"p{k}" for k in range(50))
    text = " ".join(f"w{k}" for k in range(300_000)) + " " + part + " end " + part
    r = passages.drop_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_words"] == 300_101 and r["n_removed"] == 100 and r["text"].endswith(" w299999 end")


def plain_audit(docs, labels):
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))  # a row without an id has no label
    fails = []
    for doc, text, lang in docs:
        w, text = re.findall(WORDS, text or ""), text or ""
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * (doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in docs))
        fails.append((lang or "", f, doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for x, _, _ in mine:
                total.update([f for f in order if f in x][:1])
        for order in permutations("ABCDE"):
            for step in range(5):
                letter, before = order[step], set(order[:step])
                here = [x for x in mine if letter in x[0] and not before & set(x[0])]
                kept = [x for x in mine if not (before | {letter}) & set(x[0])]
                out[part, "".join(order), step + 1] = (
                    len(kept), len(here), sum(letter in x[0] and bool(before & set(x[0])) for x in mine), sum(x[0] == letter for x in mine),
                    sum(x[1] for x in here), sum(x[2] for x in here), total[letter],
                )
    return out


def test_filter_audit(spark):
    rng = random.Random(2)
    texts = ["a b c", "A B C", "x # y", None, "", "a b c", " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k % 50}" for k in range(260)), "A " * 300, "é" * 9 + "AB", "  q", "a b c"]
    docs = [(k, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for k in range(120)] + [(None, "a b c", "en"), (None, None, None), (5, "x # y", "fr"), (5, "x # y", "fr"), (1000, "a b c", "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    cells = interactions.failures(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in interactions.audit(cells).collect()}
    assert got == plain_audit(docs, labels)
    assert interactions.audit(interactions.failures(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_document_term_matrix(spark):
    docs = [(1, "b a b é"), (2, None), (3, "a A"), (None, "b"), (3, "z" * 3000)]
    shards, terms = interactions.document_terms(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    word = {r["id"]: (r["word"], r["count"]) for r in terms.collect()}
    assert sorted(word.values()) == sorted({"b": 3, "a": 2, "é": 1, "A": 1, "z" * 3000: 1}.items()) and len(word) == 5
    got = []
    for s in shards.collect():
        ends = np.cumsum(expand(s["indptr"]))
        for r, n, end in zip(s["rows"], expand(s["indptr"]), ends, strict=True):
            ids, counts = expand(s["indices"])[end - n : end], expand(s["data"])[end - n : end]
            assert sorted(ids) == list(ids)
            got.append((r["row"]["doc_id"], {word[i][0]: c for i, c in zip(ids.tolist(), counts.tolist(), strict=True)}))
    assert sorted(got, key=str) == sorted(((d, dict(Counter(re.findall(WORDS, t or "")))) for d, t in docs), key=str)


def plain_phrases(docs, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in cands.items():
        if any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in cands.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], k + 1, *r[1:]) for k, r in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("ranges,least,top", [(10**6, 3, 2000), (40, 3, 7), (15, 2, 50), (10**6, 500, 9)])
def test_phrases(spark, monkeypatch, ranges, least, top):
    monkeypatch.setattr(phrases, "RANGE", ranges)
    monkeypatch.setattr(phrases, "SCANNED", max(5, ranges // 4))
    rng = random.Random(11)
    vocabulary = ["a", "b", "The", "é", "\x01", "a\x01", "x-y", "d'", "zz", " "]
    piece = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))
    text = lambda: "".join(piece() + rng.choice([", ", ".", "\n", "\t", " ; ", "\x0b", "!", " "]) for _ in range(rng.randint(0, 6)))
    docs = [(k, text(), rng.choice(["en", "en", "fr", None, "und", "e n", ""])) for k in range(150)]
    docs += [(k, "the quick brown fox jumps over it", "en") for k in range(6)] + [(None, None, None), (1, "", "fr"), (1, "a " * 60, "xx")]
    got = phrases.mine(spark.createDataFrame(docs, DOCS).repartition(5), least=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(docs, least, top)


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], DOCS)
    assert phrases.mine(docs).count() == 0 and phrases.mine(docs.limit(0)).count() == 0


def alike_texts():
    rng = random.Random(3)
    return [(k, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(400)), "en") for k in range(24)]


def test_phrase_ranges_of_like_streams(spark, monkeypatch):
    """Blocks of like texts have like keys at the same places; their ranges are near the wanted size all the same."""
    monkeypatch.setattr(phrases, "RANGE", 300)
    report = lambda rows, least, size: pa.table({"lang": ["range"], "words": pa.array([[rows.column("range")[0].as_py()]], pa.list_(pa.int64())), "f": pa.array([sum(len(expand(b)) for b in rows.column("counts").to_pylist())])})
    monkeypatch.setattr(phrases, "_merged", report)
    counts, _, _ = phrases.phrase_counts(spark.createDataFrame(alike_texts(), DOCS).repartition(24), 1)
    sizes = [r["f"] for r in counts.filter("lang = 'range'").collect()]
    assert sum(sizes) > 9000 and len(sizes) > 25 and max(sizes) < 600


@pytest.mark.parametrize("size", [7, 50, 333, 4000, 10**6])
def test_large_phrase_range_is_merged_in_parts(monkeypatch, size):
    """However many entries a range has, a bounded number is unpacked at once, and the counts are the same."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        columns = [rng.integers(1, 9, 300).astype(np.uint64)]
        for _ in range(phrases.LONGEST - 1):
            columns.append(np.where((columns[-1] > 0) & (rng.random(300) < 0.9), rng.integers(1, 9, 300), 0).astype(np.uint64))
        columns[0] += np.uint64(10 * (k % 2))  # a word is one of its language
        columns, counts = phrases._sorted(columns, rng.integers(1, 5, 300))
        rows.append((7, ("en", "fr")[k % 2], len(counts), *phrases._packed(columns, counts)))
    types = [pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * len(phrases.DATA)]
    whole = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["range", "lang", "n", *phrases.DATA])
    summed = lambda t: {k: sum(f for *_, f in g) for k, g in groupby(sorted((r["lang"], r["words"], r["f"]) for r in t.to_pylist()), key=lambda r: (r[0], *r[1]))}
    want = summed(phrases._counted(whole, 1))
    held, counted = [], phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda part, least: held.append(part.num_rows and sum(part.column("n").to_pylist())) or counted(part, least))
    assert summed(phrases._merged(whole, 1, size)) == want
    assert sum(held) == sum(r[2] for r in rows) and max(held) <= max(30, 1.6 * size)
    least = {k: f for k, f in want.items() if f >= 20}
    assert {k: f for k, f in summed(phrases._merged(whole, 20, size)).items() if f >= 20} == least


def test_scores_beyond_64_bits(spark):
    """Counts of a corpus far larger than any test's: the product passes 2^63 and stays exact."""
    from pyspark.sql import functions as F

    a, n, left, right = 3_000_000_000_001, 90_000_000_000_007, 3_100_000_000_003, 2_999_999_999_999_999
    held = spark.createDataFrame([(a, n, left, right)], "f long, n long, l long, r long")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    got = held.select(F.call_function("div", (exact("f") * exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), exact("l") * exact("r")).cast("long")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_words_of_equal_old_hashes(spark):
    """Two words that a weaker chain took for one are two, in hashes and for op6 and op10."""
    pair = ["fhjwelpr,!!!@@&!", "eszycidp@u{|rw@5"]
    for seed in (0, 1, 12345):
        for lower in (True, False):
            h, _ = words.word_hashes(pa.array([" ".join(pair)]), lower, seed)
            assert h[0] != h[1]
    from siltlog.llm.neardup import near_duplicates

    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    assert [r["component_id"] for r in near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2]


def test_hashes_follow_bytes():
    texts = ["Ab", "ab", "a" * 8, "a" * 9, "A" * 70, "a" * 70, "\x00", "\x00\x00"]
    one = {seed: words.word_hashes(pa.array([" ".join(texts)]), True, seed)[0] for seed in (0, 9)}
    assert one[0][0] == one[0][1] and one[0][4] == one[0][5] and len(set(one[0].tolist())) == 6 and not set(one[0].tolist()) & set(one[9].tolist())
    assert len(set(words.word_hashes(pa.array([" ".join(texts)]), False)[0].tolist())) == 8


def test_numbers_of_words(monkeypatch):
    monkeypatch.setattr(dictionary, "PART", 20)
    text = "b a b é aa b   a\tzz a " * 5 + "x" * 90
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = dictionary.spans_of(data, np.array([0, len(data)]))
    found, names = dictionary.numbers(data, starts, ends)
    assert [names[k].as_py().decode() for k in found.tolist()] == text.split() and len(names) == len(set(text.split()))
    assert dictionary.numbers(data[:0], starts[:0], ends[:0])[0].tolist() == []
    for x in ([], [0], [3, 1 << 31], [1 << 40, 7, (1 << 62) + 5]):
        assert expand(squeeze(np.array(x, np.int64))).tolist() == x


def test_special_strings_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    untouched, mine = Tokenizer.from_file(path), WordTokenizer(path, specials=True)
    texts = ["hi <|endoftext|> you", "hi <|ENDOFTEXT|> you", "a<|endoftext|>b", "a<|startoftext|>.b", "<|endoftext|><|endoftext|> x", "<<|endoftext|>>", "<|endoftext", "|>", "é<|endoftext|>É", "<|endoftext|>", None, "<|ENDOFTEXT|> <|endoftext|>"]
    for _ in range(2):
        assert [x.tolist() for x in mine.encode(pa.array(texts, pa.string()))] == [untouched.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_queries_agree_on_digests(spark, sf):
    """The query of passages gives the digest of what the operator keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {r["doc_id"]: (n, g, hashlib.sha256(t.encode()).hexdigest()) for r, (t, n, g) in zip(rows, plain_cut([r["text"] for r in rows], 35), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in passages.op11_rlz_passages(spark, sf).collect()} == want

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from siltlog.llm import kk, packing, words
from siltlog.llm.packing import WordTokenizer, op1_pack_sequences, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


ODD = ["", None, " ", "a", "The END. end, End", "don't I'LL x's", "é É ªº ß µ İ ΣΑΣ. ς", "été\u0301 cafe\u0301", "123 4a5 a1b", "<|endoftext|> a<|startoftext|>b", "\u00a0x\u2003y\x1cz\x0bw", "漢字 ひらがな 😀😀", "...!!! a...b a.b.c", "x" * 3000, "\n\n\t a \r\n b"]


def test_ids_are_the_tokenizers(tokenizer):
    import pyarrow as pa

    words = WordTokenizer(PATH)
    for _ in range(2):  # unmet, then known
        for text, got in zip(ODD, words.encode(pa.array(ODD, pa.string())), strict=True):
            assert got.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def thue_morse(n, a="a", b="b"):
    text, other = a, {a: b, b: a}
    while len(text) < n:
        text += "".join(other[c] for c in text)
    return text


def test_words_in_parts_and_of_one_hash(tokenizer, monkeypatch):
    import pyarrow as pa

    texts = [*ODD, "one two. three " * 300, thue_morse(1024) + " " + thue_morse(1024, "b", "a"), thue_morse(2048), thue_morse(2048, "b", "a"), "", "tail"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]

    def got():
        return [x.tolist() for x in WordTokenizer(PATH).encode(pa.array(texts, pa.string()))]

    assert got() == want
    monkeypatch.setattr(words, "PART", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    assert got() == want
    monkeypatch.setattr(words, "hash_spans", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(4))
    assert got() == want  # bytes tell words of one hash apart


def test_differencing():
    rng = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 1), (2, 5), (40, 7), (300, 60)):
        lengths = rng.integers(1, 500, n)
        bins, sums = kk.partition(lengths, k)
        assert sums.sum() == lengths.sum() and all(lengths[bins == b].sum() == sums[b] for b in range(k))
    bins, windows = kk.pack(np.array([60, 60, 60]), 100)  # two windows would do by the sum, but not by the pieces
    assert windows == 3 and len(set(bins.tolist())) == 3


def whole(pieces, texts, tokenizer, capacity=2048):
    by_doc, by_sequence, filled = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        filled += at
    return 1 - filled / (capacity * len(by_sequence))


def test_all_documents(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert whole(op1_pack_sequences(spark, sf).collect(), texts, tokenizer) < 0.02


def test_odd_rows(spark, tokenizer):
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(0, "again", "y", 2), (None, "no id", "z", 3)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, id string, start int"), PATH, capacity=64, piece=16).collect()
    assert {r["doc_id"] for r in got} == {None, *range(len(ODD))}
    assert sum(r["length"] for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

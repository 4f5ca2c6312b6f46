import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from test_packing import whole
from test_text_operators import brute
from tokenizers import Tokenizer

from siltlog.llm import quality
from siltlog.llm.rules import STOP_WORDS


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_columns_and_clean_documents(spark, sf, stages):
    assert [n for n, *_ in stages] == ["quality classifier", "quality rules", "line dedup", "MinHash near-dedup", "packing"]
    clean = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.count() <= before.count()
    first = stages[0]
    assert first[2].join(clean, "doc_id").count() >= 0.98 * clean.count() and first[2].count() < first[1].count()


BLANKS = " \t\n\x0b\f\r"


def held(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_rules_by_hand(stages):
    before, after = next((b, a) for n, b, a in stages if n == "quality rules")

    def passes(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
        n, size = len(w), sum(map(len, w))
        stops = sum(x in STOP_WORDS for x in w)
        bad = n < 10 or 100 * len(hit) > 20 * n or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * n or size < 2 * n or (n >= 20 and size > 12 * n)
        return not (bad or (n >= 50 and 100 * stops < 3 * n) or (len(lines) > 0 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines)))

    assert held(after) == sorted(((k, t) for k, t in held(before) if passes(t)), key=str) and after.count() < before.count()


def test_classifier_by_hand(spark, sf, stages):
    """The decisions again from the model's document scores, with posteriors in plain Python."""
    _, before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = before.collect()
    scores = model.probability(pa.array([r["text"] for r in rows], pa.string()))

    def groups(keys):
        out = {}
        for k, s in zip(keys, scores, strict=True):
            n, t = out.get(k, (0, 0.0))
            out[k] = n + 1, t + s
        return out

    def weight(of, mean):
        within, n = mean * (1 - mean), len(rows)
        spread = (sum(c * (s / c - mean) ** 2 for c, s in of.values()) - (len(of) - 1) * within) / (n - sum(c * c for c, _ in of.values()) / n)
        return min(max(within / spread - 1, 1), 1e6) if spread > 0 else 1e6

    mean = scores.sum() / len(rows)
    hosts, paths = groups([r["source"] for r in rows]), groups([(r["source"], r["lang"]) for r in rows])
    a, b = weight(hosts, mean), weight(paths, mean)
    want = []
    for r, s in zip(rows, scores, strict=True):
        (n, t), (m, u) = hosts[r["source"]], paths[r["source"], r["lang"]]
        path = (u - s + b * (t - s + a * mean) / (n - 1 + a)) / (m - 1 + b)
        odds = [math.log(p / (1 - p)) for p in (min(max(x, 1e-6), 1 - 1e-6) for x in (s, path, mean))]
        if odds[0] + odds[1] - odds[2] >= 0:
            want.append((r["doc_id"], r["text"]))
    assert held(after) == sorted(want, key=str)


def test_line_dedup_by_hand(stages):
    before, after = next((b, a) for n, b, a in stages if n == "line dedup")
    rows = before.collect()

    def key(line):
        return line.strip(BLANKS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    found = {}
    for k, r in enumerate(rows):
        for x in {key(x) for x in (r["text"] or "").split("\n")}:
            found.setdefault(x, []).append((r["doc_id"], k))
    gone = {x: max(d for d, _ in at) for x, at in found.items() if len(x) >= 40 and len(at) >= 5}
    want = []
    for r in rows:
        kept = "\n".join(x for x in (r["text"] or "").split("\n") if gone.get(key(x), r["doc_id"]) == r["doc_id"])
        want.append((r["doc_id"], kept, len(kept)))
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()) == sorted(want)


def test_near_dedup_by_hand(stages):
    before, after = next((b, a) for n, b, a in stages if n == "MinHash near-dedup")
    component = brute({r["doc_id"]: r["text"] for r in before.collect()})
    want = [(r["doc_id"], r["text"]) for r in before.collect() if component[r["doc_id"]][1] == r["doc_id"]]
    assert held(after) == sorted(want, key=str) and after.count() < before.count()


def test_packing_by_hand(stages):
    _, before, after = stages[-1]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert whole([r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in after.collect()], texts, t) < 0.05


def test_null_and_repeated_ids(spark, sf):
    good = "the cat sat on the mat and it was warm in the house that day for all of us number "
    bad = "### *** $$$ %%% |||"
    plain = {k: good + " ".join(f"{w}{k}" for w in ("one", "two", "six", "ten", "red", "sky", "sea", "oak", "elm", "ash", "fir", "bay")) for k in range(6)}
    rows = [(1, plain[1]), (1, bad), (None, bad), (None, plain[2]), (None, plain[2]), (3, plain[3]), (3, plain[3]), (4, plain[4]), (4, plain[5]), (None, plain[3]), (5, ""), (5, ""), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    passed = [(k, t) for k, t in rows if t not in (bad, "")]
    assert held(corpus_pipeline.check_rules(spark, docs, sf)) == sorted(passed, key=str)
    once = [(1, plain[1]), (1, bad), (None, plain[2]), (3, plain[3]), (4, plain[4]), (4, plain[5]), (5, ""), (6, "")]
    assert held(corpus_pipeline.dedup_documents(spark, docs, sf)) == sorted(once, key=str)
    assert held(corpus_pipeline.dedup_lines(spark, docs, sf)).count((3, plain[3])) == 2


def test_keys_survive_another_cut_of_the_files(spark, tmp_path):
    """Rows rejected at two splits of the table are the rows that go at sixteen."""
    path = f"file://{tmp_path}/docs of a%20day"
    spark.range(0, 30_000, 1, 3).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(path)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    try:
        docs = spark.read.parquet(path)
        gone = corpus_pipeline._keyed(docs).filter("doc_id % 7 = 3").select(corpus_pipeline.ROW)
        kept = corpus_pipeline._without(corpus_pipeline._keyed(docs), gone, docs)
        few = {r["doc_id"]: r[corpus_pipeline.ROW] for r in corpus_pipeline._keyed(docs).collect()}
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
        again = spark.read.parquet(path)
        assert few == {r["doc_id"]: r[corpus_pipeline.ROW] for r in corpus_pipeline._keyed(again).collect()} and len(set(few.values())) == 30_000
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k in range(30_000) if k % 7 != 3}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_stages_of_odd_tables(spark, sf):
    """Null and repeated ids, an empty table, a very long text and a column of the key's name, stage by stage."""
    words = "the of and to in is that for it was with on as by at from this are or".split()
    good = " ".join(f"{words[k % 19]} w{k}" for k in range(120)) + "."
    rows = [(None, good, "en", "a", 1), (5, good + " one two", "en", "a", 1), (5, "x", "en", "a", 1), (6, None, None, None, None), (7, " ".join(f"the l{k}" for k in range(150_000)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert {len(r["text"]) for r in corpus_pipeline.check_rules(spark, docs, sf).collect()} == {len(rows[0][1]), len(rows[1][1]), len(rows[4][1])}
    lines = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.collect()) == sorted((str(k), t or "") for k, t, *_ in rows)
    kept = corpus_pipeline.dedup_documents(spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in kept) == sorted([("5", len(rows[1][1])), ("5", 1), ("6", 0), ("7", len(rows[4][1]))])
    pieces = corpus_pipeline.pack(spark, docs, sf).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in pieces} == {None, 5, 6, 7}
    for stage in (corpus_pipeline.classify, corpus_pipeline.dedup_documents):
        with pytest.raises(ValueError):
            stage(spark, docs.withColumnRenamed("n_chars", corpus_pipeline.ROW), sf)

"""URL filter over a sorted array of rule digests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains, where the url's path starts with the rule's.
Rule = tuple[str, str, str]


def _digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\x00{path}".encode("utf-8", "surrogatepass"))


def build(rules: list[Rule], path: str) -> None:
    """Write rules as one file: four counts and the longest host, sorted digests, offsets of the full strings, path lengths, the strings.

    A repeated host and path keeps its last verdict. The file is meant to be memory-mapped: tasks on
    one machine share its pages, and only the touched pages are read.
    """
    last = {(host, path): verdict for verdict, host, path in rules}
    names = [f"{h}{p}\x00{len(h.encode())}\x00{v}".encode() for (h, p), v in last.items()]
    keys = np.array([_digest(h, p) for h, p in last], np.uint64)
    order = np.argsort(keys, kind="stable")
    names = [names[k] for k in order]
    lengths = np.unique(np.array([len(p) for _, p in last], np.int64))
    text, longest = b"".join(names), max((len(h) for h, _ in last), default=0)
    with open(path, "wb") as out:
        for part in (np.array([len(keys), len(keys) + 1, len(lengths), len(text), longest], np.int64), keys[order], np.cumsum([0, *map(len, names)], dtype=np.int64), lengths):
            out.write(part.tobytes())
        out.write(text)


class Rules:
    """Memory-mapped rules of a file made by `build`."""

    def __init__(self, path: str) -> None:
        *sizes, self.longest = np.memmap(path, np.int64, "r", shape=(5,)).tolist()
        at, parts = 40, []
        for n, kind in zip(sizes, (np.uint64, np.int64, np.int64, np.uint8), strict=True):
            parts.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        self.digests, self.offsets, lengths, self.names = parts
        self.lengths = lengths.tolist()

    def judge(self, hosts: list[str], paths: list[str], default: str) -> tuple[list[str | None], list[str]]:
        """For each url the rule of the longest fit (longest host on a tie) and the verdict."""
        of, parts, keys = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            # a suffix longer than every rule's host fits none
            suffix = host if len(host) <= self.longest else host[-self.longest - 1 :].partition(".")[2]
            while suffix:
                for n in self.lengths:
                    if n <= len(path):
                        of.append(k)
                        parts.append((suffix, path[:n]))
                        keys.append(_digest(suffix, path[:n]))
                suffix = suffix.partition(".")[2]
        rules: list[str | None] = [None] * len(hosts)
        verdicts, best = [default] * len(hosts), [(-1, -1)] * len(hosts)
        wanted = np.array(keys, np.uint64)
        lo, hi = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        for c in np.flatnonzero(hi > lo).tolist():
            host, path = parts[c]
            for at in range(int(lo[c]), int(hi[c])):  # more than one only where digests collide
                name = self.names[self.offsets[at] : self.offsets[at + 1]].tobytes().decode()
                text, size, verdict = name.rsplit("\x00", 2)
                if text == host + path and int(size) == len(host.encode()):
                    k, rank = of[c], (len(text), len(host))
                    if rank > best[k]:
                        best[k], rules[k], verdicts[k] = rank, text, verdict
        return rules, verdicts


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row: the verdict of the longest fitting rule, else `default`.

    The digest array is shipped once to each executor as a Spark file and memory-mapped by its tasks;
    each url probes it with every host suffix at a dot, joined to path prefixes of the lengths that
    rules have. A hit counts only if the stored strings are equal. Null urls and urls without `://`
    have an empty host and path and fit no rule; repeated rows are judged one by one; other columns
    are ignored.
    """
    spark = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    build(rules, path)
    spark.sparkContext.addFile(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Rules(SparkFiles.get(name))
        for rows in batches:
            rule, verdict = found.judge(rows.column(1).to_pylist(), rows.column(2).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    # [^] classes stop at the first mark; the dot of (?s) also takes line feeds
    after = F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    place = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(place, r"(?s)^[^/]*", 0)
    asked = pages.select(F.col(id_col).alias("id"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.substring(place, F.length(host) + 1, F.length(place)).alias("path"))
    return asked.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


#: Fixed values of the query.
OP2_RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), OP2_RULES)


OP2_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'),
  ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
urls AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') END, '') AS place FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(place, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(place, length(regexp_extract(place, '^[^/]*')) + 1) AS path FROM urls),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

"""The log table and its counts: Parquet by area, day and batch, with a commit file for each batch.

    root/logs/area=/day=/batch_id=             rows
    root/rollup/width=/area=/day=/batch_id=    partial counts by minute, hour and day
    root/_batches/<batch_id>.json              written last: readers see the batches listed here
    root/_state/<n>.json                       adopted days, folded counts, folders on their way out

Every commit is a file that is written only if there is none of its name. Batches do not meet: each
has its own name. Maintenance (folding counts, adopting days, dropping days) reads state n, works on
exactly the batches it has listed, and writes state n + 1; if another came first it begins anew. A
reader takes one state and one list of batches (`snapshot`), so that rows and counts agree.

A folder's area is where its batch put it. Days that were adopted since are managed wherever they lie.

Folders and commit files are reached through Hadoop's FileSystem, so any store that Spark writes
to will do. Loops on the driver go over folders and batches, never over rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.timestamps import bucket_start, floor_millis
from siltlog.operators.rollup import build_rollup, day_digests, widen
from siltlog.schema import BUCKET_MS, LOGS, ROLLUP, WIDTHS

#: Rows in a file at most, and batches that a reader lists in its filter at most; beyond that they are joined.
FILE_ROWS, LISTED = 5_000_000, 1000
#: Columns with Bloom filters, and how many distinct values a row group's filter is made for at most (about a byte each).
BLOOM = {"service": 10_000, "attributes.key_value.key": 10_000, "attributes.key_value.value.str": 500_000}


def day_of(ts: Column) -> Column:
    """UTC date of a time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (floor_millis(ts, 86_400_000) / 86_400_000).cast("int"))


def route_partition(logs: DataFrame, today: date, retention: int = 30, ahead: int = 2) -> DataFrame:
    """Adds `day` and `area`: managed within the window of kept and coming days, default outside it."""
    day = day_of(F.col("ts"))
    low, high = F.lit(today - timedelta(days=retention)), F.lit(today + timedelta(days=ahead))
    return logs.withColumn("day", day).withColumn("area", F.when(F.col("day").between(low, high), "managed").otherwise("default"))


class Files:
    """Folders of a path through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self._path(f"{self.root}/{path}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{path}"))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{path}"), True)

    def put(self, path: str, value: dict) -> bool:
        """The whole file appears at once, under its name; False if there is one already, which stays."""
        target, part = self._path(f"{self.root}/{path}"), self._path(f"{self.root}/{path}.{uuid.uuid4().hex}.part")
        if self.fs.exists(target):
            return False
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        rename = self.gateway.new_array(kinds, 1)
        rename[0] = kinds.NONE  # fails where the target is there
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(part, target, rename)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def read(self, path: str) -> dict | None:
        at = self._path(f"{self.root}/{path}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()


def _days(first: date, last: date) -> Column:
    return F.col("day").between(F.lit(first), F.lit(last))


@dataclass(frozen=True)
class Snapshot:
    """What is committed at one moment."""

    table: LogTable
    version: int
    state: dict
    batches: list[int]
    listed: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def adopted(self, day: date) -> bool:
        return any(date.fromisoformat(a) <= day <= date.fromisoformat(b) for a, b in self.state["adopted"])

    def visible(self, kind: str) -> list[int]:
        """Batches whose folders count: for counts, folded ones stand for those they replace."""
        if kind == "logs":
            return self.batches
        return sorted({*self.batches, *self.state["folds"]} - set(self.state["replaces"]))

    def _read(self, kind: str, schema, batches: list[int]) -> DataFrame:
        spark = self.table.spark
        if not self.table.files.exists(kind):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.table.root}/{kind}")
        if len(batches) <= LISTED:  # prunes folders when the query is planned
            rows = rows.filter(F.col("batch_id").isin(batches))
        else:
            listed = spark.createDataFrame([(n,) for n in batches], "batch_id long")
            rows = rows.join(F.broadcast(listed), "batch_id", "left_semi").select(*schema.fieldNames())
        gone = [(F.col("area") == area) & (F.col("day") == F.lit(date.fromisoformat(day))) & F.col("batch_id").isin(ids) for k, area, day, ids in self.state["gone"] if k == kind]
        return rows.filter(~reduce(Column.__or__, gone)) if gone else rows

    def _rows(self, kind: str, schema) -> DataFrame:
        """The visible rows; their files are listed once for a snapshot."""
        if kind not in self.listed:
            self.listed[kind] = self._read(kind, schema, self.visible(kind))
        return self.listed[kind]

    def _shown(self, rows: DataFrame) -> DataFrame:
        spans = [_days(date.fromisoformat(a), date.fromisoformat(b)) for a, b in self.state["adopted"]]
        return rows.withColumn("area", F.when(reduce(Column.__or__, spans), "managed").otherwise(F.col("area"))) if spans else rows

    def logs(self) -> DataFrame:
        """All rows, managed and default; filters on `day` prune files."""
        return self._shown(self._rows("logs", LOGS))

    def rollup(self, width: str = "1m") -> DataFrame:
        """Partial counts of one width; add them up by (bucket, service, level). Wider ones than minutes are stored when counts are folded; minutes that came since are added up here."""
        rows = self._rows("rollup", ROLLUP)
        if width == WIDTHS[0]:
            return self._shown(rows.filter(F.col("width") == width).drop("width"))
        folded = F.col("batch_id") < 0
        later = rows.filter((F.col("width") == WIDTHS[0]) & ~folded).withColumn("bucket", bucket_start(F.col("bucket"), BUCKET_MS[width]))
        return self._shown(rows.filter((F.col("width") == width) & folded).unionByName(later).drop("width"))


class LogTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # reading

    def batches(self) -> list[int]:
        """Committed batches of rows."""
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("_batches") if n.endswith(".json"))

    def snapshot(self) -> Snapshot:
        last = max((n for n in self.files.names("_state") if n.endswith(".json")), default=None)
        state = self.files.read(f"_state/{last}") if last else {"adopted": [], "folds": [], "replaces": [], "gone": []}
        return Snapshot(self, int(last.removesuffix(".json")) if last else 0, state, self.batches())

    def _advance(self, seen: Snapshot, **changes) -> bool:
        """The next state, if no other has come since `seen`."""
        return self.files.put(f"_state/{seen.version + 1:012d}.json", seen.state | changes)

    def _settle(self, change: Callable[[Snapshot], dict | None]) -> Snapshot | None:
        """A change of state, worked out anew as long as another comes first; None where there is nothing to change."""
        while True:
            seen = self.snapshot()
            changes = change(seen)
            if changes is None:
                return None
            if self._advance(seen, **changes):
                return seen

    def read_logs(self) -> DataFrame:
        """All rows, managed and default; filters on `day` prune files."""
        return self.snapshot().logs()

    def read_rollup(self, width: str = "1m") -> DataFrame:
        """Partial counts of one width; add them up by (bucket, service, level)."""
        return self.snapshot().rollup(width)

    # writing

    def append_logs(self, rows: DataFrame, batch_id: int, today: date, retention: int = 30, ahead: int = 2, metrics: dict | None = None) -> bool:
        """Rows and their partial counts, seen together once the commit file is there.

        A batch that is committed stays as it is and False comes back: its rows may have been adopted or
        folded since. One that failed half-way overwrites what it left. `rows` are records with ids; they
        should be written or cached, as they are read twice. Spark sizes the files of a day by
        bytes: small days share a task, large ones are split. The commit file holds the digests of each
        day's rows, by which audits find the days to look at.
        """
        if batch_id < 0:
            raise ValueError("a batch of rows has a number from 0 on")
        if self.files.exists(f"_batches/{batch_id}.json"):
            return False
        routed = route_partition(rows, today, retention, ahead).withColumn("batch_id", F.lit(batch_id).cast("long"))
        counts = build_rollup(routed, "area", "day").persist()
        try:
            found = day_digests(counts, "area", "day").collect()
            days = {f"{r['area']}/{r['day']}": [int(r["n"]), *map(int, r["digest"])] for r in found}
            minutes = counts.select("*", F.lit(WIDTHS[0]).alias("width"), F.lit(batch_id).cast("long").alias("batch_id"))
            self._put(minutes.hint("rebalance", "area", "day"), "rollup", ROLLUP, "width", "area", "day", "batch_id")
        finally:
            counts.unpersist()
        files = routed.hint("rebalance", "area", "day").sortWithinPartitions("area", "day", "ts", "id")
        self._put(files, "logs", LOGS, "area", "day", "batch_id", bloom=max((n for n, *_ in days.values()), default=1))
        return self.files.put(f"_batches/{batch_id}.json", {"metrics": metrics or {}, "days": days})

    def metrics(self, batch_id: int) -> dict | None:
        """What the commit of a batch says about it; None if it is not committed."""
        found = self.files.read(f"_batches/{batch_id}.json")
        return None if found is None else found["metrics"]

    def _put(self, rows: DataFrame, kind: str, schema, *folders: str, bloom: int = 0) -> None:
        """bloom: rows that a file may hold; filters are made for no more values than that."""
        made = rows.select(*schema.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for column, distinct in BLOOM.items() if bloom else ():
            made.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", min(bloom, distinct))
        made.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*folders).parquet(f"{self.root}/{kind}")

    def compact_rollup(self) -> int:
        """Fold the partial counts of all committed batches, day by day, into one batch of counts by minute, hour and day; rows stay as they are.

        The batches are listed once: exactly these are read, and the next state names them as replaced.
        One that is committed meanwhile is not among them and counts on its own. If another change of
        state came first, what was written is left for nobody and the folding begins anew. Folders
        replaced by an earlier compaction are deleted then: readers that began before this one keep theirs.
        """
        while True:
            seen = self.snapshot()
            old = seen.visible("rollup")
            if len(old) < 2:
                return 0
            new = -(uuid.uuid4().int >> 66) - 1
            minutes = seen._read("rollup", ROLLUP, old).filter(F.col("width") == WIDTHS[0])
            counts = widen(minutes.drop("width"), "area", "day")
            self._put(counts.withColumn("batch_id", F.lit(new).cast("long")).hint("rebalance", "width", "area", "day"), "rollup", ROLLUP, "width", "area", "day", "batch_id")
            done = self._advance(seen, folds=[new], replaces=sorted({*seen.state["replaces"], *(n for n in old if n >= 0)}))
            self._delete_counts([n for n in seen.state["replaces"] if n >= 0] if done else [new], keep=old)
            if done:
                self._delete_counts([n for n in seen.state["folds"] if n not in old])
                return len(old)

    def _delete_counts(self, batches: list[int], keep: Iterable[int] = ()) -> None:
        gone = {f"batch_id={n}" for n in batches} - {f"batch_id={n}" for n in keep}
        for folder in self._folders("rollup") if gone else ():
            for name in gone.intersection(self.files.names(folder)):
                self.files.delete(f"{folder}/{name}")

    # maintenance

    def _folders(self, kind: str) -> list[str]:
        """Folders of days, with their path under the root."""
        tops = [kind] if kind == "logs" else [f"{kind}/{w}" for w in self.files.names(kind) if w.startswith("width=")]
        areas = [f"{t}/{a}" for t in tops for a in self.files.names(t) if a.startswith("area=")]
        return [f"{a}/{d}" for a in areas for d in self.files.names(a) if d.startswith("day=") and not d.endswith("__HIVE_DEFAULT_PARTITION__")]

    def _places(self, kind: str, seen: Snapshot) -> list[tuple[str, str, date, bool, list[int]]]:
        """(folder, area of the folder, day, managed, committed batches) of each day's folder."""
        shown, out = set(seen.visible(kind)), []
        gone = {(k, area, day): set(ids) for k, area, day, ids in seen.state["gone"]}
        for folder in self._folders(kind):
            *_, area, day = folder.split("/")
            area, at = area.removeprefix("area="), date.fromisoformat(day.removeprefix("day="))
            held = [n for name in self.files.names(folder) if (n := int(name.removeprefix("batch_id="))) in shown]
            held = [n for n in held if n not in gone.get((kind, area, str(at)), ())]
            if held:
                out.append((folder, area, at, area == "managed" or seen.adopted(at), held))
        return out

    def days(self, kind: str = "logs", area: str = "managed") -> list[date]:
        """Days of an area that hold committed rows (or counts)."""
        return sorted({day for _, _, day, managed, _ in self._places(kind, self.snapshot()) if managed == (area == "managed")})

    def list_partitions(self) -> DataFrame:
        """(area, day, rows) of the partitions that hold committed rows."""
        return list_partitions(self.read_logs())

    def adopt_default(self, today: date, retention: int = 30, ahead: int = 2) -> list[date]:
        """Days of the default area that are managed from now on, with all their rows and counts: one write, which moves nothing. Safe to repeat."""
        low, high, moved = today - timedelta(days=retention), today + timedelta(days=ahead), []

        def change(seen: Snapshot) -> dict | None:
            moved[:] = sorted({day for kind in ("logs", "rollup") for _, _, day, managed, _ in self._places(kind, seen) if not managed and low <= day <= high})
            return {"adopted": _merged([*seen.state["adopted"], [str(low), str(high)]])} if moved else None

        self._settle(change)
        return moved

    def _drop(self, kinds: dict[str, Callable[[date], bool]]) -> dict[str, list[date]]:
        """Take managed days out of sight in one write, then delete just the folders that it names; what an earlier one left is deleted first."""
        found: dict[str, list[date]] = {}

        def change(seen: Snapshot) -> dict | None:
            self._clear(seen)
            out: dict[tuple, set] = {}
            for kind, test in kinds.items():
                for _, area, day, managed, held in self._places(kind, seen):
                    if managed and test(day):
                        out.setdefault((kind, area, str(day)), set()).update(held)
            for kind in kinds:
                found[kind] = sorted({date.fromisoformat(day) for k, _, day in out if k == kind})
            return {"gone": [[*key, sorted(ids)] for key, ids in sorted(out.items())]} if out or seen.state["gone"] else None

        if self._settle(change) is not None:
            self._clear(self.snapshot())
        return found

    def _clear(self, seen: Snapshot) -> None:
        for kind, area, day, ids in seen.state["gone"]:
            for top in [kind] if kind == "logs" else [f"{kind}/width={w}" for w in WIDTHS]:
                for n in ids:
                    self.files.delete(f"{top}/area={area}/day={day}/batch_id={n}")

    def drop_expired(self, today: date, retention: int = 30) -> list[date]:
        """Delete managed days that end at the cutoff or before it, with their counts; rows of the default area stay."""
        cutoff = today - timedelta(days=retention)
        return self._drop({"logs": lambda d: d + timedelta(days=1) <= cutoff, "rollup": lambda d: d < cutoff})["logs"]

    def purge_rollup(self, cutoff: date) -> list[date]:
        """Delete the managed counts of days before the cutoff; counts of rows in the default area stay with them."""
        return self._drop({"rollup": lambda d: d < cutoff})["rollup"]

    def maintain(self, today: date, retention: int = 30, ahead: int = 2) -> dict[str, list[date]]:
        return {"adopted": self.adopt_default(today, retention, ahead), "dropped": self.drop_expired(today, retention)}


def _merged(spans: list[list[str]]) -> list[list[str]]:
    """Spans of days in order, those that touch as one."""
    out: list[list[str]] = []
    for a, b in sorted(spans):
        if out and date.fromisoformat(a) <= date.fromisoformat(out[-1][1]) + timedelta(days=1):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def expired_days(days: Iterable[date], today: date, retention: int) -> list[date]:
    cutoff = today - timedelta(days=retention)
    return sorted(d for d in days if d + timedelta(days=1) <= cutoff)


def expired(day: Column, today: date, retention: int) -> Column:
    """The same test on a column."""
    return F.date_add(day, 1) <= F.lit(today - timedelta(days=retention))


def list_partitions(logs: DataFrame) -> DataFrame:
    return logs.groupBy("area", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))


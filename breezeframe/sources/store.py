"""Keyed Parquet tables with versions: upsert, snapshots, monthly files, parameters.

A keyed table is a folder with two parts::

    data/commit=<name>/<part>=<value>/*.parquet   rows of one upsert, never changed
    manifest/<version>.json                       what the table consists of

An upsert writes its rows once, into a folder of its own, and then publishes a manifest that
lists, per partition value, the commits to read in order. Publishing is one rename that fails
if the version exists, so readers see the old table or the new one, and of two writers the
second takes up the first one's manifest and tries the next number. Readers merge: of rows
with one key the last commit's wins; a partition of a single commit is a plain scan. A
partition with more than ``MOST_COMMITS`` is rewritten as one. Files of old versions stay
until :func:`vacuum`.

The manifest holds the union of all columns ever stored. A commit without some of them reads
as null there, so a column added by one upsert survives all later ones; a column that changes
its type is an error. An upsert replaces whole rows: columns that it lacks are null afterwards.

Rows of one upsert with the same key are ordered by ``order`` and then by content, so a
repeated upsert chooses the same rows, and a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from breezeframe.functions.features import time_key
from breezeframe.operators.windows import dedupe_last
from breezeframe.schema import SEQ, TIME
from breezeframe.session import discard

DAY = "date"
MONTH = "month"
COMMIT = "commit"
MOST_COMMITS = 8
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """One version of a table: ``folders`` has the commits of each partition folder, in order."""

    version: int = 0
    schema: T.StructType = field(default_factory=T.StructType)
    part: str = ""
    keys: tuple[str, ...] = ()
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({
            "version": self.version, "schema": self.schema.jsonValue(), "part": self.part,
            "keys": self.keys, "folders": self.folders,
        })

    @staticmethod
    def from_json(text: str) -> Manifest:
        said = json.loads(text)
        folders = {k: tuple(v) for k, v in said["folders"].items()}
        return Manifest(said["version"], T.StructType.fromJson(said["schema"]), said["part"], tuple(said["keys"]), folders)


class _Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.place().getFileSystem(self.conf)

    def place(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        place = self.place(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.place(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Whole or not at all; False if ``name`` exists."""
        draft = self.place(f"manifest/.{os.urandom(6).hex()}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.place().toUri(), self.conf)
        try:
            files.rename(draft, self.place(name), _java_array(self.jvm, options))
        except Exception as e:  # noqa: BLE001
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True


def _java_array(jvm, kind):
    from pyspark import SparkContext

    return SparkContext._gateway.new_array(kind, 0)


def _name(version: int) -> str:
    return f"manifest/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    names = _Folder(spark, path).names("manifest")
    return [int(n[:12]) for n in names if n.endswith(".json") and not n.startswith(".")]


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The given or latest version; None if there is no such table."""
    known = versions(spark, path)
    if not known:
        if set(_Folder(spark, path).names()) - {"data", "manifest"}:
            raise ValueError(f"{path} is not a keyed table")
        return None
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    return Manifest.from_json(_Folder(spark, path).read(_name(known[-1] if version is None else version)))


def _united(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; the same name must mean the same type."""
    fields = {f.name: f for f in old}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


def _wanted(value: str, kind: T.DataType, lo, hi) -> bool:
    if lo is None and hi is None:
        return True
    if value == NULL_FOLDER:
        return False
    if isinstance(kind, T.NumericType):
        value, lo, hi = float(value), None if lo is None else float(lo), None if hi is None else float(hi)
    else:  # dates and months order as text
        lo, hi = None if lo is None else str(lo), None if hi is None else str(hi)
    return (lo is None or lo <= value) and (hi is None or value <= hi)


def _scan(spark: SparkSession, path: str, m: Manifest, folders: dict[str, tuple[str, ...]]) -> DataFrame:
    places = [f"{path.rstrip('/')}/data/{COMMIT}={c}/{m.part}={v}" for v, commits in folders.items() for c in commits]
    stored = T.StructType([f for f in m.schema if f.name != m.part])
    parts = [T.StructField(COMMIT, T.StringType()), m.schema[m.part]]
    reader = spark.read.schema(T.StructType([*stored, *parts])).option("basePath", f"{path.rstrip('/')}/data")
    return reader.parquet(*places)


def read_version(spark: SparkSession, path: str, m: Manifest, lo=None, hi=None) -> DataFrame:
    """Rows of one version, partitions from ``lo`` to ``hi`` only if given."""
    kind = m.schema[m.part].dataType
    folders = {v: c for v, c in m.folders.items() if _wanted(v, kind, lo, hi)}
    plain = {v: c for v, c in folders.items() if len(c) == 1}
    several = {v: c for v, c in folders.items() if len(c) > 1}
    out = None
    if plain:
        out = _scan(spark, path, m, plain).drop(COMMIT)
    if several:
        # commits of a partition lie in the order of their generations, which all partitions share
        order = {c: n for n, c in enumerate(_generations(several.values()))}
        gen = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col(COMMIT))
        merged = dedupe_last(_scan(spark, path, m, several).withColumn("_gen", gen), [m.part, *m.keys], ["_gen"])
        merged = merged.drop("_gen", COMMIT)
        out = merged if out is None else out.unionByName(merged)
    if out is None:
        return spark.createDataFrame([], m.schema)
    return out.select(*m.schema.names)


def _generations(lists) -> list[str]:
    """One order that keeps the order of every list."""
    after: dict[str, set[str]] = {}
    for commits in lists:
        for n, c in enumerate(commits):
            after.setdefault(c, set()).update(commits[:n][-1:])
    out: list[str] = []
    done: set[str] = set()
    for start in after:
        stack = [start]
        while stack:
            top = stack[-1]
            open_ = [c for c in after[top] if c not in done]
            if open_:
                stack += open_
            else:
                stack.pop()
                if top not in done:
                    done.add(top)
                    out.append(top)
    return out


def read_table(spark: SparkSession, path: str, lo=None, hi=None, version: int | None = None) -> DataFrame:
    """The table as of its latest or a given version, last row per key; ``lo`` and ``hi`` bound
    the partitions that are listed and scanned. Later commits do not change what was read."""
    m = manifest_of(spark, path, version)
    if m is None:
        raise FileNotFoundError(path)
    return read_version(spark, path, m, lo, hi)


def _write(df: DataFrame, path: str, part: str) -> tuple[str, list[str]]:
    """Rows into a folder of their own; gives its name and the partition folders in it."""
    commit = os.urandom(8).hex()
    folder = f"data/{COMMIT}={commit}"
    # adaptive execution splits a large day and joins small ones
    df.hint("rebalance", F.col(part)).write.partitionBy(part).parquet(f"{path.rstrip('/')}/{folder}")
    names = _Folder(df.sparkSession, path).names(folder)
    return commit, [n.split("=", 1)[1] for n in names if n.startswith(f"{part}=")]


def _commit(spark: SparkSession, path: str, change) -> Manifest:
    """Publish ``change`` of the latest manifest; begins anew when another writer was first."""
    folder = _Folder(spark, path)
    while True:
        m = change(manifest_of(spark, path) if versions(spark, path) else Manifest())
        if m is None:
            return manifest_of(spark, path)
        if folder.publish(_name(m.version), m.to_json()):
            return m


def upsert_rows(new: DataFrame, path: str, part: str, keys: Sequence[str], order: Sequence[str]) -> Manifest | None:
    """Insert or replace rows by ``part`` and ``keys``, last one winning; one write of ``new``."""
    spark = new.sparkSession
    old = manifest_of(spark, path)
    if old and (old.part, old.keys) != (part, tuple(keys)):
        raise ValueError(f"{path} is keyed by {old.part}, {', '.join(old.keys)}")
    _united(old.schema if old else T.StructType(), new.schema)  # a clash fails before anything is written
    rows = dedupe_last(_tied(new), [part, *keys], [*order, "_tie"]).drop("_tie")
    commit, values = _write(rows, path, part)
    if not values:
        discard(spark, f"{path.rstrip('/')}/data/{COMMIT}={commit}")
        return old

    def change(m: Manifest) -> Manifest:
        folders = dict(m.folders)
        for v in values:
            folders[v] = (*folders.get(v, ()), commit)
        return Manifest(m.version + 1, _united(m.schema, new.schema), part, tuple(keys), folders)

    m = _commit(spark, path, change)
    full = [v for v in values if len(m.folders[v]) > MOST_COMMITS]
    return compact(spark, path, full) if full else m


def compact(spark: SparkSession, path: str, values: Sequence[str] | None = None) -> Manifest:
    """Rewrite partitions of several commits (all of them, or ``values``) as one. What other
    writers add meanwhile stays on top."""
    m = manifest_of(spark, path)
    chosen = {v: c for v, c in m.folders.items() if len(c) > 1 and (values is None or v in values)}
    if not chosen:
        return m
    rows = read_version(spark, path, replace(m, folders=chosen))
    commit, written = _write(rows, path, m.part)

    def change(now: Manifest) -> Manifest | None:
        folders = dict(now.folders)
        for v in written:
            if folders.get(v, ())[: len(chosen[v])] != chosen[v]:
                return None  # someone else rewrote it
            folders[v] = (commit, *folders[v][len(chosen[v]) :])
        return replace(now, version=now.version + 1, folders=folders)

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop all but the last ``keep`` versions and the commits that only those read; gives the
    number of commits dropped. Not while somebody writes, or reads an older version."""
    known = versions(spark, path)
    stays = {c for v in known[-keep:] for cs in manifest_of(spark, path, v).folders.values() for c in cs}
    gone = [n for n in _Folder(spark, path).names("data") if n.split("=", 1)[1] not in stays]
    for v in known[:-keep]:
        discard(spark, f"{path.rstrip('/')}/{_name(v)}")
    for n in gone:
        discard(spark, f"{path.rstrip('/')}/data/{n}")
    return len(gone)


def is_missing(e: AnalysisException) -> bool:
    """Whether the path does not exist; any other fault of a table must not pass for that."""
    return e.getCondition() == "PATH_NOT_FOUND"


def _tied(df: DataFrame) -> DataFrame:
    return df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in sorted(df.columns)]))


def upsert_features(
    df: DataFrame, path: str, keys: Sequence[str] = ("station", "time_str"), order: Sequence[str] = (TIME,)
) -> bool:
    """Insert or replace rows by station and hour key. No rows means nothing to do."""
    if TIME not in df.columns:
        raise ValueError("missing columns: time")
    upsert_rows(df.withColumn("time_str", time_key()).withColumn(DAY, F.to_date(TIME)), path, DAY, keys, order)
    return True


def append_monthly(
    df: DataFrame, path: str, keys: Sequence[str] = ("station", TIME), order: Sequence[str] = (SEQ,)
) -> None:
    """Append to the month's file, keeping the last row per key."""
    upsert_rows(df.withColumn(MONTH, F.date_format(TIME, "yyyyMM")), path, MONTH, keys, order)


def write_training_set(df: DataFrame, path: str, version: int) -> str:
    """Immutable snapshot; an existing version is an error."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def latest_version(versions: DataFrame, name: str = "name", version: str = "version", path: str = "path") -> DataFrame:
    """Path of the highest version per name; versions compare as numbers."""
    v = F.col(version).cast("int")
    return versions.groupBy(name).agg(F.max(v).alias(version), F.max_by(path, v).alias(path))


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

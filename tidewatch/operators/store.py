"""Tables in versions: a batch rewrites the parts it touches, and all its tables appear at once.

A table is Parquet in parts, by hash of its key, or one part for each batch that appended to it. A
version is a small marker file that names every table's parts; it is written last and renamed into
place, so readers see all tables of a batch or none, a batch that died leaves the version before it
readable, and a batch that is run again writes its own folders again. Parts that a batch doesn't
touch keep their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Parts of a keyed table; a batch of fewer keys touches as many parts as it has keys at most.
PARTS = 64
_MARKERS = "_versions"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


class VersionedTables:
    """The tables below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that are whole, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(_MARKERS) if n.endswith(".json"))

    def _marker(self, version: int) -> dict:
        stream = self._files.open(self._path(_MARKERS, f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict:
        """What a version (the newest) says of each table; none yet gives none."""
        known = self.versions()
        return self._marker(known[-1] if version is None else version) if known else {}

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version (the newest); None if it isn't there."""
        table = self.tables(version).get(name)
        return self.parts_of(name, table) if table else None

    def parts_of(self, name: str, table: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{name}/{place}" for part, place in sorted(table["parts"].items()) if only is None or int(part) in only]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def batch(self, version: int) -> Batch:
        return Batch(self, version)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the oldest markers but `keep`, then folders that no marker left names; no reader of older versions may run."""
        known = self.versions()
        for version in known[:-keep]:
            self._files.delete(self._path(_MARKERS, f"{version:012d}.json"), False)
        named: dict[str, set[str]] = {}
        for version in known[-keep:]:
            for name, table in self._marker(version).items():
                named.setdefault(name, set()).update(table["parts"].values())
        for name, places in named.items():
            for folder in self._names(name):
                own = {p for p in places if p == folder or p.startswith(f"{folder}/")}
                if not own and int(folder.removeprefix("v=")) <= known[-1]:
                    self._files.delete(self._path(name, folder), True)
                elif own and folder not in own:
                    for part in self._names(name, folder):
                        if part.startswith("part=") and f"{folder}/{part}" not in own:
                            self._files.delete(self._path(name, folder, part), True)


class Batch:
    """The tables of one version in the making. Until commit() nothing of it is seen."""

    def __init__(self, store: VersionedTables, version: int):
        earlier = [v for v in store.versions() if v < version]
        self.store, self.version, self.done = store, version, version in store.versions()
        self.before = store._marker(earlier[-1]) if earlier else {}
        self.tables = dict(self.before)

    def stored(self, name: str, keys: DataFrame | None = None, key: str = "id") -> DataFrame | None:
        """A table as it was before the batch; with keys only the parts that can hold them."""
        table = self.before.get(name)
        if table is None:
            return None
        touched = None if keys is None else {r.part for r in keys.select(part_of(key, table["count"]).alias("part")).distinct().collect()}  # numbers below count
        return self.store.parts_of(name, table, touched)

    def now(self, name: str) -> DataFrame:
        """A table as the batch has it so far."""
        return self.store.parts_of(name, self.tables[name])

    def added(self, name: str) -> DataFrame:
        """What this batch has appended to a table."""
        return self.store.parts_of(name, self.tables[name], {self.version})

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """The whole table anew."""
        rows.write.mode("overwrite").parquet(f"{self.store.folder}/{name}/v={self.version}")
        self.tables[name] = {"schema": rows.schema.jsonValue(), "count": 1, "parts": {"0": f"v={self.version}"}}
        return self.now(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """More rows, as a part of their own."""
        rows.write.mode("overwrite").parquet(f"{self.store.folder}/{name}/v={self.version}")
        known = self.before.get(name, {"parts": {}})["parts"]
        self.tables[name] = {"schema": rows.schema.jsonValue(), "count": 1, "parts": known | {str(self.version): f"v={self.version}"}}
        return self.now(name)

    def upsert(self, name: str, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", parts: int = PARTS) -> DataFrame:
        """merge(stored, fresh) in the parts that hold fresh's keys; merge may neither change keys nor add others.

        fresh is read twice, so it should be written. Rows are dealt by part, whose sizes are alike.
        """
        table = self.before.get(name) or {"schema": fresh.schema.jsonValue(), "count": parts, "parts": {}}
        count = table["count"]
        touched = {r.part for r in fresh.select(part_of(key, count).alias("part")).distinct().collect()}  # numbers below count
        stored = self.store.parts_of(name, table, touched)
        merged = merge(stored, fresh).select(*stored.columns).withColumn("part", part_of(key, count))
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.store.folder}/{name}/v={self.version}")
        made = set(self.store._names(name, f"v={self.version}"))
        kept = {p: place for p, place in table["parts"].items() if int(p) not in touched}
        new = {str(p): f"v={self.version}/part={p}" for p in sorted(touched) if f"part={p}" in made}
        self.tables[name] = table | {"parts": kept | new}
        return self.now(name)

    def commit(self) -> None:
        """Makes the version seen, by renaming its marker into place. A version that is there already stays as it is."""
        if self.done:
            return
        files, temporary = self.store._files, self.store._path(_MARKERS, f".{self.version:012d}.making")
        files.mkdirs(self.store._path(_MARKERS))
        stream = files.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(self.tables).encode()))
        finally:
            stream.close()
        if not files.rename(temporary, self.store._path(_MARKERS, f"{self.version:012d}.json")):
            raise OSError(f"version {self.version} could not be committed")
        self.done = True

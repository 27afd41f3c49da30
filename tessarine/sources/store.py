"""Versioned tables: a set of relations that changes as one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class TableStore:
    """Relations below one folder; a version is a small file that names the folder of each.

    ``commit`` writes the relations that change completely, each to a folder of a new unique
    name, and then renames the version's file into place, so readers see all of a version or
    none of it. A failed write leaves the last version as it was; of two writers of the same
    version the one that renames second fails, and neither touches the other's folders.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self._system.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._system.listStatus(self._path(""))]
        return sorted(int(n[8:]) for n in names if n.startswith("current-"))

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, str]:
        """The folder of each relation that a version has."""
        if not version:
            return {}
        file = self._system.open(self._path(f"current-{version}"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A relation; column pruning makes reading a few of its columns cheap."""
        folder = self.manifest(self.version() if version is None else version).get(name)
        if folder is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{folder}")

    def commit(self, **tables: DataFrame) -> int:
        """Write a new version with these relations; the others stay where they are."""
        old = self.version()
        new, folders = old + 1, self.manifest(old)
        unique = uuid.uuid4().hex
        for name, rows in tables.items():
            folders[name] = f"data/{name}-{unique}"
            rows.select(*(rows[f.name].cast(f.dataType) for f in self.schemas[name].fields)).write.parquet(f"{self.root}/{folders[name]}")
        pending = self._path(f"pending-{unique}")
        out = self._system.create(pending, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._system.exists(self._path(f"current-{new}")) or not self._system.rename(pending, self._path(f"current-{new}")):
            self._system.delete(pending, False)
            raise RuntimeError(f"version {new} is there already")
        return new

    def compact(self, keep: int = 1, files: int | None = None) -> int:
        """Rewrite the relations into few files and delete all but the last versions, and what only they name."""
        tables = {name: self.read(name) for name in self.manifest(self.version())}
        version = self.commit(**{n: t.repartition(files) if files else t.coalesce(max(1, len(t.inputFiles()) // 4)) for n, t in tables.items()})
        gone = self.versions()[: -keep or None]
        used = {folder for v in set(self.versions()) - set(gone) for folder in self.manifest(v).values()}
        for old in gone:
            for folder in set(self.manifest(old).values()) - used:
                self._system.delete(self._path(folder), True)
            self._system.delete(self._path(f"current-{old}"), False)
        return version

"""Versioned tables in a shared folder: directories of Parquet files, named by a manifest that is renamed into place.

A version writes new directories beside the old ones and then publishes a manifest that lists the
directories in force, by partition. Readers see the version before or the one after; a failed job or
a lost executor leaves files that no manifest names, which `vacuum` removes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A partition that lies in more directories than this is put together at the next occasion.
MOST_DIRS = 8


class Store:
    """The manifest and directories of one versioned table or group of tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p))) if self.fs.exists(self._path(p)) else []

    def _manifests(self) -> list[str]:
        return [n for n in self.names(f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self, name: str | None = None) -> dict:
        found = [name] if name else self._manifests()
        if not found:
            return {"version": 0}
        stream = self.fs.open(self._path(f"{self.root}/manifest/{found[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Write beside, then rename: readers see the whole manifest or none. A version is published once."""
        p = f"{self.root}/manifest/{manifest['version']:09d}.json"
        stream = self.fs.create(self._path(p + ".tmp"), True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.fs.exists(self._path(p)) or not self.fs.rename(self._path(p + ".tmp"), self._path(p)):
            raise RuntimeError(f"another writer has published {p}")

    def read(self, parts: dict[str, list[str]], only: Iterable[str] | None = None) -> DataFrame | None:
        """The directories of the given partitions (all if None); None if there are none."""
        dirs = [d for p, ds in sorted(parts.items()) if only is None or p in only for d in ds]
        return self.spark.read.parquet(*[f"{self.root}/{d}" for d in dirs]) if dirs else None

    def write(self, df: DataFrame, column: str, name: str, version: int) -> dict[str, str]:
        """Write a table by the values of a column, which stays in the files; returns each value's directory."""
        at = f"{name}/{version:09d}"
        while self.names(f"{self.root}/{at}"):  # left by a failed attempt, or a second table of this version
            at += "x"
        # a value's rows are put together before they are written, large values in several files
        df.withColumn("_dir", F.col(column)).hint("rebalance", "_dir").write.partitionBy("_dir").parquet(f"{self.root}/{at}")
        return {unquote(n.split("=", 1)[1]): f"{at}/{n}" for n in self.names(f"{self.root}/{at}") if n.startswith("_dir=")}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove manifests before the last `keep` and the directories that none of those left names; returns the directories removed."""
        names = self._manifests()
        for n in names[: -keep or None]:
            self.fs.delete(self._path(f"{self.root}/manifest/{n}"), False)
        used: set[str] = set()

        def walk(x) -> None:
            if isinstance(x, str):
                used.add(x)
            elif isinstance(x, (list, dict)):
                for y in x.values() if isinstance(x, dict) else x:
                    walk(y)

        for n in names[-keep:]:
            walk(self.manifest(n))
        gone = []
        for table in self.names(self.root):
            for version in self.names(f"{self.root}/{table}") if table not in ("manifest", "checkpoint") else []:
                at = f"{table}/{version}"
                inner = [f"{at}/{n}" for n in self.names(f"{self.root}/{at}") if n.startswith("_dir=")]
                dead = [d for d in inner if d not in used] if inner else [at] if at not in used else []
                # a version that nothing names goes as a whole
                for d in [at] if inner and len(dead) == len(inner) else dead:
                    self.fs.delete(self._path(f"{self.root}/{d}"), True)
                    gone.append(d)
        return gone


def bucket(keys: list[str], buckets: int):
    """The bucket of a row by a hash of its key columns, as text."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")

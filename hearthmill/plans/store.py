"""Tables as versioned folders with an atomic pointer: the write side of every materialization.

Spark cannot rewrite a Parquet table that it is reading. A rewrite therefore goes
to a new version folder and becomes current by one atomic rename of a pointer
file; readers of the old version keep it until it is vacuumed. An append adds
files to the current version through Spark's own commit protocol. Works on any
Hadoop file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Named tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.prefix = f"{schema}." if schema else ""
        self.views: dict[str, object] = {}

    # --- file system

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _context(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str:
        return f"{self.root}/{self.prefix}{name}"

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self._folder(name)}/_current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _point(self, name: str, version: str) -> None:
        folder = self._folder(name)
        fs, tmp = self._fs(f"{folder}/_current.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(version.encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context().rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{folder}/_current"), options)

    # --- reading

    def exists(self, name: str) -> bool:
        return name in self.views or self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        """The current version; a view is expanded anew each time."""
        if name in self.views:
            return self.views[name]()
        version = self._current(name)
        if version is None:
            raise KeyError(f"no such table: {name}")
        return self.spark.read.parquet(f"{self._folder(name)}/{version}")

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        own = [n[len(self.prefix) :] for n in found if n.startswith(self.prefix) and (self.prefix or "." not in n)]
        return sorted({*[n for n in own if self._current(n) is not None], *self.views})

    def counts(self) -> dict[str, int]:
        """Rows of each table: layer statistics."""
        return {n: self.read(n).count() for n in self.names()}

    # --- writing

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Replace a table as a whole; ``df`` may read the table itself."""
        version = f"v-{uuid.uuid4().hex}"
        w = df.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self._folder(name)}/{version}")
        self._point(name, version)
        self.views.pop(name, None)
        return self.read(name)

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Add rows, matched by column name; a missing table is created. A missing column is null, an unknown one an error."""
        version = self._current(name)
        if version is None:
            return self.write(name, df, partition_by)
        now = self.read(name)
        if odd := set(df.columns) - set(now.columns):
            raise ValueError(f"unknown columns: {', '.join(sorted(odd))}")
        full = now.limit(0).unionByName(df, allowMissingColumns=True)
        w = full.select([c for c in now.columns]).write.mode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self._folder(name)}/{version}")
        return self.read(name)

    def truncate(self, name: str) -> None:
        """Keep the table and its columns, drop its rows."""
        self.write(name, self.read(name).limit(0))

    def drop(self, name: str) -> None:
        """Drop a table or view; a missing one is no error."""
        self.views.pop(name, None)
        fs, p = self._fs(self._folder(name))
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        """Rename a table or view over whatever bears the new name."""
        if old in self.views:
            self.drop(new)
            self.views[new] = self.views.pop(old)
            return
        if self._current(old) is None:
            raise KeyError(f"no such table: {old}")
        self.drop(new)
        fs, a = self._fs(self._folder(old))
        fs.rename(a, self._fs(self._folder(new))[1])

    def create_view(self, name: str, make) -> None:
        """A named query, expanded when it is read; replaces a table of the same name."""
        if self._current(name) is not None:
            self.drop(name)
        self.views[name] = make

    def clone(self, source: str, name: str) -> None:
        """A view over the other table, as stores without shallow copies do."""
        self.create_view(name, lambda: self.read(source))

    def vacuum(self, name: str) -> int:
        """Delete versions that are no longer current; returns how many."""
        keep, n = self._current(name), 0
        fs, p = self._fs(self._folder(name))
        for s in fs.listStatus(p):
            v = s.getPath().getName()
            if v.startswith("v-") and v != keep:
                fs.delete(s.getPath(), True)
                n += 1
        return n

"""Tables of versions: each commit is one manifest that appears whole or not at all; a pass over some roots rewrites their files alone."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class VersionedTable:
    """Rows under ``where``, a folder of any file system that Spark knows, split by the column ``root``.

    Files of a commit are written first, in a folder of their own; then a manifest, which names the folder of each root, is
    created under the next number.  Creating it is the commit: a reader takes the manifest of the highest number, so a
    write that fails before leaves the table as it was, and of two writers at once one gets ``Conflict``.  A manifest has an
    entry a root, not a row.
    """

    def __init__(self, spark: SparkSession, where: str, root: str = "root_id") -> None:
        self.spark, self.where, self.root = spark, where.rstrip("/"), root
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, inner: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{inner}" if inner else self.where)

    def _names(self, inner: str) -> list[str]:
        at = self._path(inner)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """schema and folders (by root) of a version, the newest unless named; of an empty table none."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "folders": {}}
        if version not in known:
            raise ValueError(f"{self.where} has no version {version}")
        text = self.spark.read.option("wholetext", True).text(f"{self.where}/manifests/{version:012d}.json").first()[0]
        return json.loads(text)

    def _commit(self, before: dict, schema: T.StructType, folders: dict[str, str]) -> int:
        version = before["version"] + 1
        ready = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(ready, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "folders": folders}).encode()))
        out.close()
        final = self._path(f"manifests/{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(ready, final):
            self._fs.delete(ready, False)
            raise Conflict(f"{self.where} has version {version} already")
        return version

    def _write(self, rows: DataFrame) -> dict[str, str]:
        inner = f"data/{uuid.uuid4().hex}"
        try:
            rows.withColumn("__root", F.col(self.root)).write.partitionBy("__root").parquet(f"{self.where}/{inner}")
        except PySparkException:
            self._fs.delete(self._path(inner), True)
            raise
        return {name: f"{inner}/{name}" for name in self._names(inner) if name.startswith("__root=")}

    def overwrite(self, rows: DataFrame) -> int:
        """A version of ``rows`` alone; returns its number."""
        before = self.manifest()
        return self._commit(before, rows.schema, self._write(rows))

    def replace_roots(self, rows: DataFrame, touched: DataFrame) -> int:
        """A version in which the roots ``touched`` have the rows of ``rows`` and all others keep their files.

        Rows of other roots are an error; a touched root without rows is gone.
        """
        before = self.manifest()
        if before["schema"] is not None and T.StructType.fromJson(before["schema"]).fieldNames() != rows.columns:
            raise ValueError(f"the columns of {self.where} are {T.StructType.fromJson(before['schema']).fieldNames()}, not {rows.columns}")
        names = touched.select(F.col(self.root).alias("__root")).distinct()
        marks = self._write(names.select(F.lit(True).alias("touched"), F.col("__root").alias(self.root)))  # the names of their folders, as the writer spells them
        new = self._write(rows)
        if strange := set(new) - set(marks):
            raise ValueError(f"rows of roots that aren't touched: {sorted(strange)[:5]}")
        kept = {name: at for name, at in before["folders"].items() if name not in marks}
        return self._commit(before, rows.schema, kept | new)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"{self.where} has no version yet")
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.where}/{at}" for at in m["folders"].values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the ``keep`` newest versions and delete the files that none of those names; returns how many folders went."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        used = {at.split("/")[1] for v in known[-keep:] for at in self.manifest(v)["folders"].values()}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        return len(gone)

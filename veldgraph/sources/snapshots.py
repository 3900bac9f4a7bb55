"""Tables of Parquet files that are merged into, with a snapshot for each version.

A table's rows are in buckets of its key. A merge reads and rewrites the buckets that its
changes touch, into new files, and then puts a new list of files in place by a rename.
Until then readers see the version before; a merge that fails leaves files that no
version lists. Old versions stay readable, since no file is changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another writer has made the version that this merge was for."""


class SnapshotTable:
    """A table at a path that driver and executors share. ``key`` names the columns that tell rows apart."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._file("versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def _listed(self, version: int) -> dict:
        """A version's schema and its folder of each bucket."""
        rows = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).collect()  # a folder a bucket
        return json.loads(rows[0][0])

    def _rows(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        listed = self._listed(version)
        folders = [f for b, f in listed["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(listed["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version} at {self.path}")
        return self._rows(known[-1] if version is None else version)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
        """Makes a new version of ``combine(old rows of touched buckets, changes)`` and returns its number.

        With ``version`` that one is made from the one before; if it is there already, nothing
        is done, so a step that is run again changes nothing. ``combine`` must keep rows in
        their bucket, that is, not change keys. Hot buckets are several files.
        """
        known = self.versions()
        last = known[-1] if known else 0
        if version is not None and version in known:
            return version
        target = last + 1 if version is None else version
        if target != last + 1:
            raise ValueError(f"version {target} can't follow {last}")
        touched = sorted(r[0] for r in changes.select(self.bucket().alias(BUCKET)).distinct().collect())  # a row a bucket
        old = self._rows(last, touched) if last else self.spark.createDataFrame([], changes.schema)
        merged = combine(old, changes)
        folder = uuid.uuid4().hex
        merged.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        folders = {b: f for b, f in (self._listed(last)["folders"] if last else {}).items() if int(b) not in touched}
        fs, path = self._file(f"data/{folder}")
        written = [f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith(BUCKET)]
        folders |= {name.split("=")[1]: f"{folder}/{name}" for name in written}
        self._publish(target, {"schema": json.loads(merged.schema.json()), "folders": folders})
        return target

    def _publish(self, version: int, listed: dict) -> None:
        fs, draft = self._file(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        _, place = self._file(f"versions/{version:012d}")
        fs.mkdirs(place.getParent())
        # A rename never replaces a file of a distributed file system; local ones are asked first.
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there")

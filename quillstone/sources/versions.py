"""Tables by key: versions whose manifest names the files of each bucket, upserts that rewrite the buckets they touch, pages by the key.

A row's bucket follows from its key. A version is one small file that says in which folder each bucket lies; it is written
last, under a name that must not be there yet. Readers take the highest version, so they see all of a write or nothing of
it, and of two writers that began with the same version one fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import tables


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@dataclass(frozen=True)
class KeyedTable:
    """A folder with ``versions``, and a folder of buckets for each write."""

    spark: SparkSession
    path: str
    key: str

    @classmethod
    def create(cls, path: str, rows: DataFrame, key: str, buckets: int = 64) -> KeyedTable:
        """A first version of these rows, whose keys are different."""
        table = cls(rows.sparkSession, path, key)
        if table.versions():
            raise FileExistsError(f"there is a table at {path}")
        table._commit(1, buckets, table._write(rows, 1, buckets))
        return table

    def versions(self) -> list[int]:
        fs, where = _fs(self.spark, f"{self.path}/versions")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json")) if fs.exists(where) else []

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, and the folder of each bucket that has rows."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no version {version or ''} of a table at {self.path}")
        rows = self.spark.read.text(f"{self.path}/versions/{version or known[-1]:09d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last by default; ``only`` of these buckets."""
        held = self.manifest(version)
        folders = [f"{self.path}/{folder}" for b, folder in held["folders"].items() if only is None or int(b) in only]
        read = self.spark.read.schema(held["schema"])
        return read.parquet(*folders) if folders else self.spark.createDataFrame([], held["schema"])

    def upsert(self, new: DataFrame) -> int:
        """New rows replace those with their keys; only buckets that they fall into are read and written. The number of the new version."""
        return self._replace(new, new)

    def delete(self, keys: DataFrame) -> int:
        return self._replace(keys, None)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes what the last ``keep`` versions don't name, and the versions before them; the folders that went."""
        known = self.versions()
        named = {f"{self.path}/{folder}" for v in known[-keep:] for folder in self.manifest(v)["folders"].values()}
        fs, where = _fs(self.spark, self.path)
        gone = []
        for data in fs.listStatus(where):
            if data.getPath().getName().startswith("data-"):
                for bucket in fs.listStatus(data.getPath()):
                    if bucket.isDirectory() and f"{self.path}/{data.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                        fs.delete(bucket.getPath(), True)
                        gone.append(f"{data.getPath().getName()}/{bucket.getPath().getName()}")
        for v in known[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/versions/{v:09d}.json")[1], False)
        return sorted(gone)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _replace(self, keys: DataFrame, new: DataFrame | None) -> int:
        held = self.manifest()
        n, version = held["buckets"], held["version"] + 1
        touched = [r[0] for r in keys.select(self.bucket(n).alias("b")).distinct().collect()]  # at most the number of buckets
        rest = self.read(only=touched).join(keys.select(self.key).distinct(), self.key, "left_anti")
        rows = rest if new is None else rest.unionByName(new.select(*rest.columns))
        folders = {b: f for b, f in held["folders"].items() if int(b) not in touched} | self._write(rows, version, n)["folders"]
        self._commit(version, n, {"schema": held["schema"], "folders": folders})
        return version

    def _write(self, rows: DataFrame, version: int, buckets: int) -> dict:
        # writers that began with the same version write to folders of their own
        folder = f"data-{version:09d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
        rows.withColumn("bucket_of_key", self.bucket(buckets)).repartition("bucket_of_key").write.partitionBy("bucket_of_key").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        fs, where = _fs(self.spark, f"{self.path}/{folder}")
        present = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return {"schema": ddl, "folders": {p.removeprefix("bucket_of_key="): f"{folder}/{p}" for p in present}}

    def _commit(self, version: int, buckets: int, held: dict) -> None:
        fs, where = _fs(self.spark, f"{self.path}/versions/{version:09d}.json")
        if fs.exists(where):
            raise FileExistsError(f"version {version} was written meanwhile")
        out = fs.create(where, False)  # fails if another writer was first
        out.writeBytes(json.dumps({"version": version, "buckets": buckets, **held}))
        out.close()


def write_ordered(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """The rows in files that follow each other by a key whose values are different, and beside them each file's bounds. Without
    a number of files, Spark makes them of the size that it is set to."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = rows.sparkSession.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
    tables.write_table(written.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")), f"{path}-bounds")


def page_after(spark: SparkSession, path: str, key: str, after: object = None, limit: int = 20) -> tuple[DataFrame, object]:
    """The next 1 to 100 rows after a key, of files that can hold them; and the key to go on from, or None at the end.

    A page costs the same wherever it is: bounds say which files to read, and a task keeps its first rows only.
    """
    limit = min(100, max(1, limit))
    bounds = spark.read.parquet(f"{path}-bounds")
    ahead = bounds if after is None else bounds.where(F.col("high") > F.lit(after))
    files, sure = [], 0
    for f in ahead.orderBy("low").limit(limit + 2).collect():  # a file holds a row at least
        files.append(f["file"])
        sure += f["n"] if after is None or f["low"] > after else 1
        if sure > limit:
            break
    if not files:
        return spark.read.parquet(path).limit(0), None
    rows = spark.read.parquet(*files)
    rows = (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key)
    keys = [r[0] for r in rows.select(key).limit(limit + 1).collect()]
    return rows.limit(limit), keys[limit - 1] if len(keys) > limit else None


def migrate_ordered(spark: SparkSession, source: str, target: str, vector: str = "embedding", files: int = 16) -> tuple[int, int]:
    """Copies a table of ``write_ordered`` without rows that have no vector, some files at a time in the order of the key; steps that
    are done already, by an earlier call that was cut off, are left as they are. Steps there are, and steps made now."""
    ordered = [r["file"] for r in spark.read.parquet(f"{source}-bounds").orderBy("low").select("file").collect()]  # names of files, no rows
    steps = [ordered[k : k + files] for k in range(0, len(ordered), files)]
    made = 0
    for k, own in enumerate(steps):
        to = f"{target}/step={k:06d}"
        if not tables.exists(spark, f"{to}/_SUCCESS"):
            tables.write_table(spark.read.parquet(*own).where(F.col(vector).isNotNull()), to)
            made += 1
    return len(steps), made

"""Sinks: schemas brought in line, tables by day, and batches that may come twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.constraints import violated


def align_schema(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the columns of ``schema``, in its order and types; those they lack are null, others are left out."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_day_partitioned(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Writes ``rows`` by day of ``at``: the days that they have are replaced, all others stay. Each day is written by the tasks that hold it."""
    dated = rows.withColumn("day", F.to_date(at))
    dated.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_checked(rows: DataFrame, checks: Mapping[str, str], path: str) -> dict[str, int]:
    """Writes ``rows`` in one pass, good ones under ``quarantined=false`` and others, with the names of the checks they break, under ``quarantined=true``.

    Returns how many rows there are, how many are quarantined, and how many break each check, counted in that same pass.
    """
    told, seen = rows.withColumn("violated", violated(checks)), Observation(f"checked-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("violated") > 0).alias("quarantined"), *(F.count_if(F.array_contains("violated", n)).alias(n) for n in checks)]
    told.observe(seen, *counts).withColumn("quarantined", F.size("violated") > 0).write.partitionBy("quarantined").parquet(path)
    return {n: int(c) for n, c in seen.get.items()}


class BatchLedger:
    """A table of a stream's batches that takes each batch once, whatever comes twice or breaks off, without reading what it holds.

    A batch is written to a folder of its own name and then committed: a small file that names the folder is written aside and
    renamed to the batch's number, which a file system does as one step and only once. A batch whose number is committed is
    passed over; folders that no commit names, left by a writer that died, are seen by no reader and go with the next ``clean``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda *p: spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _folder(self, commit: str) -> str:
        file = self._fs.open(self._at("commits", commit))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def stage(self, batch: DataFrame, number: int) -> str:
        """Writes a batch where no reader looks; returns its folder."""
        folder = f"{number}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(self, number: int, folder: str) -> bool:
        """Makes a staged batch part of the table; false, and nothing happens, if the number has been committed."""
        aside, name = self._at("aside", folder), f"{number:020d}"
        out = self._fs.create(aside, True)
        out.write(bytearray(folder.encode()))
        out.close()
        self._fs.mkdirs(self._at("commits"))
        done = not self._fs.exists(self._at("commits", name)) and self._fs.rename(aside, self._at("commits", name))
        if not done:
            self._fs.delete(aside, False)
        return bool(done)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if f"{number:020d}" not in self._names("commits"):
            self.commit(number, self.stage(batch, number))

    def read(self, schema: StructType) -> DataFrame:
        folders = [f"{self.path}/data/{self._folder(c)}" for c in self._names("commits")]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self) -> int:
        """Deletes folders that no commit names; no writer may be at work. Returns how many."""
        held = {self._folder(c) for c in self._names("commits")}
        gone = [f for f in self._names("data") if f not in held]
        for f in gone:
            self._fs.delete(self._at("data", f), True)
        return len(gone)


def append_absent(path: str, key: str, at: str = "ts") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends to the table at ``path`` the rows whose ``key`` it lacks, so that a batch may come twice.

    Only the days that a batch has are read. Of rows with one key in a batch one is kept.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("day", F.to_date(at))
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            held = spark.read.schema(new.schema).parquet(path)
            days = new.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
            held = held.filter(F.col("day").between(F.lit(days.low), F.lit(days.high))) if days.low is not None else held.limit(0)
            new = new.join(held.select(key), key, "left_anti").select(*new.columns)
        new.write.partitionBy("day").mode("append").parquet(path)

    return write

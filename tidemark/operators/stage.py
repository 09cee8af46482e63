"""Intermediate tables in the folder that driver and executors share, so that what several parts of a job read is made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: What has been made within ``kept_only``, of this thread alone.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local folder serves a local master; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage is cut, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_only(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with its rows written, and all that it has made on the way, tables and streams' state, deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, token = shared_path(spark, query.__name__), _made.set([])
        try:
            rows = query(spark, sf_dir)
            rows.write.parquet(path)
            return spark.read.schema(rows.schema).parquet(path)
        finally:
            for made in _made.get() or ():
                at = spark._jvm.org.apache.hadoop.fs.Path(made)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made.reset(token)

    return run

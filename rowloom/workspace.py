"""Tables written to the folder the cluster shares, which cut lineage and hold still."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local master that names no checkpoint folder (tests, single machines).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/rowloom"

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default where that is unset and the master
    is local too. On a cluster a folder of one machine would lose rows, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def let_workers_import(spark: SparkSession) -> None:
    """Python workers start with this library on their path, however the driver found it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted with the tables."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """The same rows, evaluated once and read back from Parquet; any names and types that Parquet holds.

    The table stays until :func:`release` or the driver's end.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # a field may have any name
    plain.write.parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns)])


def mark() -> int:
    """A point to which :func:`release` can go back."""
    return len(_made)


def release(since: int = 0) -> None:
    """Delete the tables written so far, or since a mark; nothing may read them any more."""
    while len(_made) > since:
        spark, path = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
            pass


atexit.register(release)

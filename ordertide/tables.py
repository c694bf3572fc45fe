"""Shared tables: where lineage is cut, and how the inputs are read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session that has none (in tests) gets a temporary folder, which goes when the driver's
    Python ends; on a cluster executors wouldn't see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ordertide-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared store; missing ones are fine."""
    with contextlib.suppress(Exception):  # at interpreter exit the gateway may be gone already
        place, fs = hadoop_path(spark, path)
        fs.delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/ordertide/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def write(df: DataFrame, name: str) -> str:
    """Write `df` as Parquet in the shared folder; the path, to be read any number of times."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: lineage ends here and lost executors cost no recomputation."""
    path = write(df, name)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done.written_at = path
    return done


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() gave, once what reads them is written."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a temporary folder is made and kept for the session on a local
    master only; on a cluster no executor would see it, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what lies there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder by Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no result reads any more."""
    delete(spark, path)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path

"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words of the texts: runs of anything but space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where that is unset a temporary folder is made, but only for a local master: on a
    cluster the executors would not see it, so there it is an error.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_dir)
    return set_dir


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # noqa: BLE001 - Spark may have gone before
        pass


class Scratch:
    """Intermediate tables written as Parquet below the shared folder.

    A written table cuts the lineage and survives lost executors. `drop` deletes a
    table that nothing reads any more; what is left, read by results that are still
    to be worked out, goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        if not self._n:
            atexit.register(_delete_at_exit, self.spark, self.root)
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := getattr(df, "_millrace_path", None):
                _delete(self.spark, path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name

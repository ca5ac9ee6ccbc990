"""Shared scratch tables.

Loops and reused intermediate results are cut by writing them as Parquet tables below the
folder that the cluster names in ``spark.checkpoint.dir``. A written table survives the loss
of executors, keeps lineage short and gives the optimizer real sizes for its join choice.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage, so that Spark deletes the shuffle files of plans that are done with."""
    spark._jvm.System.gc()


class Scratch:
    """A private folder for the intermediate tables of one run."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/graphproof/{purpose}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table and return a fresh read of it."""
        target = f"{self.path}/{name}"
        df.write.mode("errorifexists").parquet(target)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete one table that nothing reads any more, and the shuffle files of plans that are done with."""
        self._delete(f"{self.path}/{name}")
        free_shuffles(self.spark)

    def close(self) -> None:
        """Delete the tables of the run. Frames that read them can't be used afterwards."""
        self._delete(self.path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read_levels(self, name: str, first: int, last: int, schema) -> DataFrame:
        """Union of the written tables ``name-first`` .. ``name-last`` as one scan."""
        paths = [f"{self.path}/{name}-{i}" for i in range(max(first, 0), last + 1)]
        return self.spark.read.schema(schema).parquet(*paths)

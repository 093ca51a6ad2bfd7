"""Tables written between the steps of an operator, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is broadcast holds at most so many bytes of rows, by a count of them; beyond it a join shuffles.
BROADCAST_BYTES = 32 << 20
#: The folders that this process has made and not removed.
_MADE: list[str] = []


class Scratch:
    """A folder of this run's own under ``spark.checkpoint.dir``.

    ``keep`` writes a DataFrame as Parquet and reads it again, which cuts lineage
    and lets a lost executor reread rather than recompute.  ``drop`` removes what
    no later plan reads, ``clear`` what results have read.  Where the setting is absent, a local master gets
    ``/tmp/checkpoints``; a cluster must name a shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file:/tmp/checkpoints"
        self.spark, self.base = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self.base)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as it was written, in a folder for each value of ``by`` if that is named."""
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Remove all that this process has kept, once its results are read or written; the number of folders."""
    made = [*_MADE]
    for folder in made:
        _delete(spark, folder)
        _MADE.remove(folder)
    return len(made)


def small(rows: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``rows``, to be broadcast if their bytes, ``row_bytes`` each, are within ``BROADCAST_BYTES``."""
    if isinstance(row_bytes, Column):
        size = rows.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    else:
        size = rows.count() * row_bytes
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table over as many tasks as there are cores, where its scan has fewer.

    A file of one row group is one task however many cores there are.  The scan of a
    large table has more tasks than there are cores, whatever its number of files, so
    nothing of it is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

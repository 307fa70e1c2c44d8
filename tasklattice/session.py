"""Session helpers: the shared folder, and tables that cut a long lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    A local session without the setting gets a temporary folder. A cluster
    session without it is refused, because a folder of one machine would not
    be seen by the others.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        kept = sc._jsc.sc().getCheckpointDir()
        named = kept.get() if kept.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tasklattice-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path, on any file system, is a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder while an operator runs.

    A written table survives the loss of executors and ends the lineage. What
    a later table replaces is dropped at once; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS[self.root] = spark

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


@atexit.register
def _clean() -> None:
    for root, spark in _ROOTS.items():
        try:
            _delete(spark, root)
        except Exception:  # the JVM may be gone already
            pass


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in fewer partitions than there are cores; else unchanged.

    For steps whose work per byte is large, such as Python on texts. Large
    inputs come in many partitions, so that nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df

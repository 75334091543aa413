"""Tables in the cluster's shared folder, and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, local mode (tests) gets a temporary one, and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """df in at most four partitions a core of the cluster (32 at least), for a small table that comes out of many shuffle partitions.

    Hadoop starts a process (chmod) for each file that it makes in a local folder; until that runs its own program it shares the executor's pages.
    """
    return df.coalesce(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Deletes a table that staged() wrote and that nothing will read again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


class Scratch:
    """Staged tables that are deleted together once nothing reads them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over the whole table (one aggregate row reaches the driver)."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)

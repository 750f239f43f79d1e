"""Tables that cut lineage: written to the shared folder of the cluster and read back."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs in one process (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="strandmill-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back with the same schema; ``files``: of small tables, how many at most."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df = df if files is None else df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no later plan reads."""
    for table in tables:
        remove(table.sparkSession, table.table_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system through Hadoop's own API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Size of the input as the optimizer estimates it from file sizes; where it can't (rows from memory), that of its strings."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    texts = [c for c, kind in df.dtypes if kind == "string"]
    total = df.agg(*[F.sum(F.octet_length(F.col(f"`{c}`"))) for c in texts], F.count("*")).first()
    return sum(x or 0 for x in total)


def release(spark: SparkSession) -> None:
    """Lets Spark clear the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if a few small files would leave cores idle; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df

"""Where operators keep what must outlive a stage: the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, one of our own in local
    mode; on a cluster that's an error, as machines don't share their folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='litsieve-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, settle: bool = False) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back. The shuffle
    files of what was written are free then; Spark deletes them as the driver collects
    its garbage, which is asked for here, as a driver with little to do may wait long.
    With ``settle``, for large shuffles, it is given the time to delete them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(2 if settle else 1):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7 if settle else 0)
    out = spark.read.schema(df.schema).parquet(path)
    out._litsieve_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._litsieve_path)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> Column:
    """Names a row by 128 bits of its content (two 64-bit hashes of unlike seeds), so that
    repeated rows share their results."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

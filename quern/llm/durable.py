"""Tables that cut a job's lineage and outlive lost executors.

Intermediate results are written as Parquet below the shared folder that the
cluster names in ``spark.checkpoint.dir`` and read back.  Where the session
names none on one machine (tests), a folder under Spark's warehouse is used and
remembered in the session, so it is never a task's temporary folder.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_durable"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.parquet(path)
    release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Spark's cleaner deletes them when the driver's collector finds their plans
    unreachable; a driver with little to do may not collect for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if base.split(":", 1)[-1].strip("/") not in folder:
            raise ValueError(f"{folder} is outside {base}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

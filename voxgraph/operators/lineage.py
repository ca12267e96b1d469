"""Cutting the lineage of iterative plans in a way that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is empty, a local master gets a temporary folder; a cluster without the setting is an
    error, as no machine-local folder would be visible to all executors.
    """
    folder = spark.conf.get(CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CONF} is not set; iterative operators need a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="voxgraph-")
    spark.conf.set(CONF, folder)
    return folder


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that cut() gave and that no plan needs any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("cut-"):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back: its plan starts from that table.

    Where drop() doesn't delete the table before, the file system does when the driver's JVM ends.
    """
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)

"""Reading input tables and writing intermediates that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the session names in ``spark.checkpoint.dir`` (or was given through
    ``setCheckpointDir``). Only where neither is set, as in tests on one machine, is a temporary
    folder made and set.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="vektorium-")
        sc.setCheckpointDir(there)
        there = sc.getCheckpointDir() or there
    return there.rstrip("/")


def stored(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table, partitioned ``by`` a column if one is named.

    Cuts the lineage: later stages read files that outlive any executor. The files are as small as
    zstd parquet makes them and disappear with the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by ``stored`` once nothing needs it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

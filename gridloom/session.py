"""Session helpers: durable lineage cuts and sized shuffles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session that names none (tests, a notebook) gets a local temporary
    folder, removed when Python ends, and only if its master is local.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost nothing.

    Parquet rather than ``checkpoint()``: the copy is columnar, so later steps read
    only their columns, and Spark knows its size when it plans joins.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for the right side of a join that sorts both sides, whatever Spark takes their size to be.

    Spark reckons with compressed files, and takes exploded rows for no more than what
    they are made of: a table it finds small enough to broadcast may fill the driver.
    """
    return df.hint("merge")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's copies within the shared one."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Deletes this application's copies. For when no DataFrame made so far is needed any more; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is read in fewer parts than there are.

    For work that takes far longer than moving its rows. A large input is read in many
    parts and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df

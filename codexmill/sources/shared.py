"""The folder that the driver and all executors share, for tables between two steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only on one machine (a local master) may that be unset: then a temporary folder is made, remembered in the
    session, and removed when Python ends. On a cluster it must be set, since executors don't see such a folder.
    """
    found = spark.conf.get(DIR_CONF, None) or spark.sparkContext.getConf().get(DIR_CONF)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{DIR_CONF} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(DIR_CONF, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: later steps read it instead of computing it again, also after the loss of an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own by application, where no setting names one: the setting can't be changed in a running session.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder of our own only in local mode where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in OWN:
            own = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            OWN[app] = "file://" + own
        folder = OWN[app]
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back.

    This cuts the lineage like checkpoint(), keeps the data columnar and compressed, and survives the loss of
    executors because every task's output lies in shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables written to the shared folder, so that plans of loops stay short and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


_folders: dict[str, str] = {}


def _local(spark) -> str:
    """A temporary folder, for a session in one process only: on a cluster nobody else could read it."""
    master = spark.conf.get("spark.master", "")
    if not master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and the executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sextant_"))


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or _local(spark)
    path = f"{base.rstrip('/')}/sextant/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

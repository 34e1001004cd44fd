"""Tables between the rounds of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs on this machine."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (known or "file://" + tempfile.mkdtemp(prefix="curator-")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table there."""
    path = f"{root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._curator_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes such tables when nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._curator_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

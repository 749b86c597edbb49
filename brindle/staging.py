"""Tables staged in the folder that driver and executors share, so that lineage is cut and a lost executor costs nothing upstream."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset, local mode gets a folder of its own, and a cluster an error: a folder
    of the driver's machine would not be seen by its executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/brindle"


def staged_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, tag: str) -> DataFrame:
    return staged_at(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more, through Hadoop's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, renamed into place, so that a reader finds the old text or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(beside, place, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())

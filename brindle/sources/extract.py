"""Extracts: CSV and NDJSON as the warehouse writes them, Parquet, and EXPORT DATA to one wildcard path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(df: DataFrame) -> DataFrame:
    """Every scalar as text and every array and struct as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields])


def extract(df: DataFrame, path: str, form: str = "CSV", delimiter: str = ",", header: bool = True) -> None:
    """Writes a folder of files, one a partition: CSV (nulls as nothing, nested values as JSON), NDJSON (scalars as text) or Parquet."""
    if form == "CSV":
        as_text(df).write.mode("error").option("sep", delimiter).option("header", header).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
    elif form == "NEWLINE_DELIMITED_JSON":
        scalars = [F.col(f"`{f.name}`") if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
        df.select(*scalars).write.mode("error").option("ignoreNullFields", "false").json(path)
    elif form == "PARQUET":
        df.write.mode("error").parquet(path)
    else:
        raise ValueError(f"unsupported destination format {form}")


def export_data(df: DataFrame, uri: str, form: str = "CSV", overwrite: bool = False, header: bool = True, delimiter: str = ",") -> list[str]:
    """EXPORT DATA: the files of `uri`, whose one `*` becomes 000000000000, 000000000001 and so on.  Numbers stay numbers in JSON.

    Spark writes and commits a folder of a fresh name beside the target; its part files are then renamed through Hadoop's file system, so any store works.
    Without `overwrite` all targets are looked for before the first is made.  Empty texts are quoted and nulls are not, so a load tells them apart.
    """
    if uri.count("*") != 1:
        raise ValueError("the uri holds one wildcard")
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    before, after = uri.split("*")
    temp = f"{before}export-{uuid.uuid4().hex}"
    if form == "CSV":
        as_text(df).write.option("sep", delimiter).option("header", header).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(temp)
    elif form == "JSON":
        df.write.json(temp)
    elif form == "PARQUET":
        df.write.parquet(temp)
    else:
        raise ValueError(f"unsupported export format {form}")
    system = hadoop(temp).getFileSystem(conf)
    try:
        parts = sorted(s.getPath().toString() for s in system.listStatus(hadoop(temp)) if s.getPath().getName().startswith("part-"))
        targets = [hadoop(f"{before}{i:012d}{after}") for i in range(len(parts))]
        if not overwrite and (there := [t.toString() for t in targets if system.exists(t)]):
            raise FileExistsError(there[0])
        for part, target in zip(parts, targets, strict=True):
            if system.exists(target):
                system.delete(target, False)
            if not system.rename(hadoop(part), target):
                raise OSError(f"{target.toString()} could not be made")
    finally:
        system.delete(hadoop(temp), True)
    return [t.toString() for t in targets]

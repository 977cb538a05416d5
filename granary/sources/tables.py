"""Parquet tables: opening, naming, describing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def open_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """The table at path, registered as `view` if given. Only the columns that a query names are read."""
    frame = spark.read.parquet(path)
    if view:
        frame.createOrReplaceTempView(view)
    return frame


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely at path, on any file system that Spark knows."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name that driver and executors share: below spark.checkpoint.dir, or a temporary folder on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/granary-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def table_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def type_name(t: T.DataType) -> str:
    """The dialect's name of a type."""
    return {"tinyint": "I32", "smallint": "I32", "int": "I32", "bigint": "I64", "float": "F64", "double": "F64", "string": "STRING", "boolean": "BOOL"}.get(t.simpleString(), t.simpleString().upper())


def describe(frame: DataFrame, name: str) -> dict:
    columns = [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable, "encoding": "PARQUET"} for f in frame.schema.fields]
    return {"name": name, "rowCount": frame.count(), "columns": columns}

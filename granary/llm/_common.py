"""What the modules of this folder share: text conventions, column naming, and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of those taken, letter case apart."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name += "_"
    return name


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors see; one folder above it is the application's.

    Where the setting is absent, as in tests on one machine, a temporary folder stands in; a cluster
    without the setting is refused, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="granary-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        base = "file://" + _local["dir"]
    return f"{base.rstrip('/')}/granary-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Folders that materialise() wrote, in order.
_written: list[str] = []


def materialise(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/{label}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that materialise() wrote and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        _delete(spark, folder)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What build() returns, written; every table that was materialised on the way there is deleted, as nothing needs it any more."""
    began = len(_written)
    out = materialise(spark, build(), label)
    for folder in _written[began:-1]:
        _delete(spark, folder)
    del _written[began:-1]
    return out

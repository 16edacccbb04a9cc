"""Tables and files that a query writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Names of those that are tables of the session.
_TABLES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only a plain local session without that setting gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    folder = f"{shared_dir(spark)}/lumenframe-{uuid.uuid4().hex}"
    _WRITTEN.append(folder)
    return folder


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: the lineage ends there,
    so that a lost executor costs no recomputation of what came before.

    A query's result reads such tables lazily, so they stay until drop_scratch."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """The same for a table dealt by key into so many parts: it stays so, as a bucket for
    each.  What is read back meets others by key without being moved, however often;
    the hint is that of fixtures.by_image."""
    spark = df.sparkSession
    folder = work_folder(spark)
    name = "scratch_" + folder.rsplit("-", 1)[1]
    df.write.format("parquet").option("path", f"{folder}/{name}").bucketBy(parts, key).sortBy(key, *order).saveAsTable(name)
    _TABLES[folder] = name
    return spark.table(name).hint("merge")


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders that this process made, from number `since` on.  Call it when
    the results that read them are stored."""
    for folder in _WRITTEN[since:]:
        if folder in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(folder)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:]

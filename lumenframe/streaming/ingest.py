"""SM-01: incremental ingest of documents from a folder, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _done(spark: SparkSession, folder: str) -> bool:
    """Whether a write into the folder was finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _commit(spark: SparkSession, folder: str, rows: int, rejected: int) -> None:
    spark.createDataFrame([(rows, rejected)], "n_rows long, n_rejected long").coalesce(1).write.mode("overwrite").json(folder)


def ingest_new_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Processes the JSON files of a folder that have not been processed yet, then stops.

    The checkpoint remembers files.  A micro-batch is written to folders of its own, named
    by the stream's id and the batch's number: data, and rejected for lines that are no
    JSON.  It then counts as taken by a commit beside them.  A batch that is tried again
    writes over what an earlier try left, and one that is committed is not written again,
    so that readers of commits (see ingested) get each row once.  Streams with checkpoints
    of their own may share a sink."""
    raw = spark.readStream.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(source)

    def write(batch: DataFrame, number: int) -> None:
        stream = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        place = f"stream={stream}/batch={number}"
        if _done(spark, f"{sink}/commits/{place}"):
            return
        batch.persist()
        good, bad = batch.where(F.col("_corrupt").isNull()).drop("_corrupt"), batch.where(F.col("_corrupt").isNotNull()).select("_corrupt")
        transform(good).write.mode("overwrite").parquet(f"{sink}/data/{place}")
        bad.write.mode("overwrite").parquet(f"{sink}/rejected/{place}")
        counts = batch.agg(F.count_if(F.col("_corrupt").isNull()), F.count_if(F.col("_corrupt").isNotNull())).first()
        _commit(spark, f"{sink}/commits/{place}", *counts)
        batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, sink: str, part: str = "data") -> DataFrame:
    """The rows of all committed batches; part is data or rejected."""
    keys = "stream string, batch long"
    commits = spark.read.schema(f"n_rows long, n_rejected long, {keys}").json(f"{sink}/commits").select("stream", "batch")
    rows = spark.read.parquet(f"{sink}/{part}")
    rows = rows.withColumns({"stream": F.col("stream").cast("string"), "batch": F.col("batch").cast("long")})
    return rows.join(commits, ["stream", "batch"], "left_semi").drop("stream", "batch")

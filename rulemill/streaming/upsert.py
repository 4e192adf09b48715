"""Continuous arrival of chunks: a file stream whose micro-batches go through the batch index sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rulemill.operators.indexing import sync_actions
from rulemill.schemas import CHUNK_COLUMNS, CHUNKS
from rulemill.session import cut, written
from rulemill.sources.io import read_chunks, write_chunks


def stream_chunks(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sync_batch(batch: DataFrame, index_path: str, log_path: str, batch_id: int) -> None:
    """Bring the chunks of one micro-batch into the index and log what was done.

    A batch is a part of its documents: chunks are put in by chunk_id, the others of the document stay. Only
    a document with a true ``complete`` (an optional boolean column of the batch) in some row is taken to be whole, and
    chunks it lacks are deleted. Of a chunk that comes twice in a batch the row of the greatest hash counts. A repeated batch leaves
    the index as it is, and the log as it was first written. A missing index is an empty one.
    """
    spark = batch.sparkSession
    complete = F.coalesce(F.col("complete"), F.lit(False)) if "complete" in batch.columns else F.lit(False)
    held = batch.withColumn("complete", complete).where("chunk_id is not null and doc_id is not null").persist()
    try:
        newest = Window.partitionBy("chunk_id").orderBy(F.desc("content_hash"), "status")
        once = held.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
        docs = held.groupBy("doc_id").agg(F.max("complete").alias("whole"))
        touched = cut(existing(spark, index_path).join(docs, "doc_id"))  # what is read must not be what is being rewritten
        stays = touched.where("not whole").join(once.select("chunk_id"), "chunk_id", "left_anti").select(CHUNK_COLUMNS)
        log = f"{log_path}/batch={batch_id}"
        if not written(spark, log):
            changed = touched.join(stays.select("chunk_id"), "chunk_id", "left_anti").select(CHUNK_COLUMNS)
            sync_actions(once, changed).write.mode("overwrite").parquet(log)
        write_chunks(stays.unionByName(once.select(CHUNK_COLUMNS)), index_path)
    finally:
        held.unpersist()


def existing(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return read_chunks(spark, path) if there else spark.createDataFrame([], CHUNKS)


def start_sync(stream: DataFrame, index_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """A query that takes all files there are and ends; the checkpoint makes the next start go on from there."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: sync_batch(batch, index_path, log_path, n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

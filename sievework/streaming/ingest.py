"""Continuous ingest: new document rows are split, deduplicated and stored batch by batch.

The checkpoint takes the place of a work queue with recovery: a batch that is
run again writes the same version again. A batch that can't be processed leaves
its documents failed, with the error and without chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.config import Splitting
from sievework.operators import dedup, split
from sievework.sources.files import write_version


def chunks_of(documents: DataFrame, config: Splitting = Splitting()) -> DataFrame:
    """(document_id, chunk_index, content, content_hash) of rows (id, text), numbered from 1 after deduplication."""
    from pyspark.sql.window import Window

    pieces = documents.select(F.col("id").alias("document_id"), F.posexplode(split.split_by_rules(F.col("text"), config)).alias("pos", "content"))
    kept = dedup.exact(pieces, ["pos"]).where("kept")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("pos"))
    return kept.select("document_id", number.alias("chunk_index"), "content", F.col("hash").alias("content_hash"))


#: Columns of stored chunks.
CHUNKS = "document_id bigint, chunk_index int, content string, content_hash string"


def replace_documents(rows: DataFrame, store: str, version: int, process: Callable[[DataFrame], DataFrame] = chunks_of) -> None:
    """Store a version of the documents (id, text): their chunks and success, or failure with its reason and no chunks."""
    ids = rows.select(F.col("id").alias("document_id")).distinct()
    try:
        write_version(ids.select("document_id", F.lit(1).alias("status"), F.lit(None).cast("string").alias("process_error")), process(rows), store, version)
    except Exception as error:
        failed = ids.select("document_id", F.lit(2).alias("status"), F.lit(str(error)[:500]).alias("process_error"))
        write_version(failed, None, store, version)


def ingest_stream(spark: SparkSession, landing: str, schema: str, store: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Process what has landed so far and stop; run it again for what lands later. Batch numbers are versions."""
    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    batch = lambda rows, number: replace_documents(rows, store, number)
    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on batch and streaming frames."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        timed.groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )

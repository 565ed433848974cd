"""Stream records to files: compaction, fan-out by topic, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def compact(records: DataFrame, path: str, checkpoint: str, interval: str | None = "100 milliseconds") -> StreamingQuery:
    """Writes (timestamp_ns, type_id, payload) as Parquet, payload in base64; without an interval, all that is there, then ends.

    Nothing is dropped: a source's limits (maxFilesPerTrigger, maxBytesPerTrigger) hold the stream back instead. Files
    appear whole, and the checkpoint keeps what has been written over restarts.
    """
    out = records.select("timestamp_ns", "type_id", F.base64(F.col("payload").cast("binary")).alias("payload"))
    writer = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(path)


def held_back(spark, path: str, schema, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A stream over the files of ``path`` that takes at most so many files or bytes a micro-batch: the watermark by which a slow sink holds its source back."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def flush(query: StreamingQuery) -> None:
    query.processAllAvailable()


def fan_out(records: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, topic: str = "topic") -> StreamingQuery:
    """Each micro-batch goes to the sink of every topic; a sink must take a batch that comes again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                sink(batch.filter(F.col(topic) == name), number)
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Counts(StreamingQueryListener):
    """Rows and batches that queries of the session have processed."""

    def __init__(self):
        self.rows = self.batches = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

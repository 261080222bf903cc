"""A stream of page messages kept as documents, and the same from a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import merge_messages


class DocumentsWriter:
    """Keeps the messages of a stream in a shared folder, from which documents are made when they are read; every trigger is a checkpoint.

    A batch writes its own messages, each once, and no others, so its cost doesn't grow with what was there before; a batch that is run again replaces
    its own. ``merge`` makes the documents of all kept messages, so the answer is that of a table with the same messages. A file source's
    ``maxFilesPerTrigger`` bounds a batch.
    """

    def __init__(self, messages: DataFrame, folder: str, checkpoint: str | None = None, once: bool = True, merge: Callable[[DataFrame], DataFrame] = merge_messages):
        self.spark, self.folder, self.merge, self.schema, self.batches = messages.sparkSession, folder, merge, messages.schema, 0
        writer = messages.writeStream.outputMode("append").foreachBatch(self._write).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
        self.query: StreamingQuery = (writer.trigger(availableNow=True) if once else writer).start()

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.distinct().write.mode("overwrite").parquet(f"{self.folder}/messages/batch={batch}")
        self.batches = max(self.batches, batch + 1)

    def current(self) -> DataFrame:
        """The documents as of the last trigger; none before the first."""
        if not self.batches:
            return self.merge(self.spark.createDataFrame([], self.schema))
        return self.merge(self.spark.read.schema(self.schema).parquet(f"{self.folder}/messages").select(*self.schema.names))


def documents_batch(messages: DataFrame) -> DataFrame:
    return merge_messages(messages)

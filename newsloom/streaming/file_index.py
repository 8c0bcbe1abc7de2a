"""Indexing of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from newsloom.engine import EvidenceEngine
from newsloom.sources import files

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def index_stream(engine: EvidenceEngine, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of new files is parsed and committed like a call of index_files.

    Updates are by key, so a batch that is replayed after a failure changes nothing.
    """
    arriving = engine.spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{" + ",".join(s[1:] for s in files.SUFFIXES) + "}").load(folder)

    def commit(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            engine.index_pages(files.parse_files(batch))

    writer = arriving.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

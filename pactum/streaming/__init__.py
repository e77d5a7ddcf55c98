"""Programs over streams. Row-level programs keep no state, so a streaming DataFrame is transformed as a batch is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.rules import REJECT
from ..program import Program


def quarantined(program: Program, stream: DataFrame, checkpoint: str, accepted: str, rejected: str, **options) -> DataStreamWriter:
    """A writer that puts accepted records and rejected ones (with their messages) into two parquet folders.

    A batch that is written again after a failure replaces what it had written, so each record arrives once.
    """
    marked = program.transform(stream, mode="quarantine", **options)

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where(F.size(REJECT) == 0).drop(REJECT)
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.where(F.size(REJECT) > 0).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def per_batch(program: Program, stream: DataFrame, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """Runs a whole-list program over every micro-batch and hands its result to `sink`."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(program.aggregate(batch, **options), number))

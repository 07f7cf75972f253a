"""Gates and deduplication for streams.

Extensions: the batch operators of the same names, applied to micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def stream_gate(
    stream: DataFrame, gate: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str
) -> DataStreamWriter:
    """A writer that puts batches passing every check under ``good``, the others under ``bad``.

    ``gate`` gives ``check, ok, found`` rows. Each batch is written to a folder named by its
    number, so a batch that is repeated after a failure replaces itself.
    """

    def publish(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            failed = gate(kept).filter(~F.col("ok")).limit(1).count()
            kept.write.mode("overwrite").parquet(f"{bad if failed else good}/batch={number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def stream_dedupe(stream: DataFrame, by: list[str], time: str, delay: str) -> DataFrame:
    """The first row per key; state is dropped once a key is ``delay`` behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(by)

"""New pool records scored as they arrive, against a fixed first side.

The batch operators have no streaming form of their own; each micro-batch runs
them on its records. Token statistics are those of the micro-batch, so scores
of small batches differ from those of one run over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinmatch.operators import blocking as B


def match_new_records(stream: DataFrame, s1: DataFrame, path: str, state: str, channels: tuple[B.Channel, ...] = B.CHANNELS) -> StreamingQuery:
    """Appends the candidates of new records to a folder, one subfolder a batch, so that a repeated batch replaces itself. Ends when what is there has been read."""

    def batch(records: DataFrame, number: int) -> None:
        B.candidates(s1, records, channels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()

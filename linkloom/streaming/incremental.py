"""New candidate records meet a static reference table batch by batch.

An extension: batch and stream share the blocking keys and votes, so a stream
of all records gives what one batch over them gives, except that caps on list
lengths hold per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import normalize
from linkloom.operators import blocking


def stream_votes(s1: DataFrame, arriving: DataFrame, out: str, checkpoint: str, config: blocking.BlockingConfig = blocking.BlockingConfig()) -> StreamingQuery:
    """Votes of each micro-batch of raw records against normalised S1 records, appended to ``out``.

    A batch that is run again after a failure overwrites its own folder, so
    each pair is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = blocking.votes(s1, normalize.normalize(batch), config)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

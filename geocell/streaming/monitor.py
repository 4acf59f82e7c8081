"""The skew monitor as a stream: each batch of routed rows refreshes the partition counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import skew


def monitor(routed: DataFrame, on_skew: Callable[[DataFrame, int], None], checkpoint: str, period: str = "5 seconds") -> StreamingQuery:
    """Calls on_skew(stats, batch) for each batch whose largest fifth of partitions holds nearly four fifths of the rows."""

    def look(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("part").count().withColumnRenamed("count", "cnt")
        r = skew.power_law(counts).first()
        if r and r["skewed"]:
            on_skew(skew.stats(batch), number)

    return routed.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()

"""Messages as a stream, deduplicated by id, handed to an upsert batch by batch.

The source system loads in weekly batches; this is an extension. Document frequencies are
global, so keywords are still computed from the stored documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(messages: DataFrame, schema: str, key: str = "video_id", time: str = "timestamp", late: str = "1 day") -> DataFrame:
    """(value, timestamp) -> parsed rows, one for each id within the lateness bound, which bounds the state."""
    rows = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("d"), F.col(time).alias("_time")).select("d.*", "_time")
    return rows.withWatermark("_time", late).dropDuplicatesWithinWatermark([key])


def load(rows: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Document frequencies of terms as a stream.

State is kept by bucket of terms: a map from the term to its documents so far and when it was last seen, so a batch
touches the terms that it holds and no others. Terms unseen for ``idle`` expire by a timer of their bucket.
Counts are sums over documents, so any split of the documents into batches, with restarts between them, leads to the same
frequencies; repeated documents are for ``ingest.deduplicated`` to drop.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "token string, df long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Frequencies(StatefulProcessor):
    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.terms = handle.getMapState("terms", "token string", "df long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in rows:
            held.update(frame["token"].tolist())
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        out = []
        for token, n in held.items():
            old = self.terms.getValue((token,))
            df = n + (old[0] if old else 0)
            self.terms.updateValue((token,), (df, now))
            out.append((token, df))
        if self.idle_ms:
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=["token", "df"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        least = timerValues.getCurrentProcessingTimeInMs() - self.idle_ms
        gone = [k for k, v in self.terms.iterator() if v[1] <= least]
        for k in gone:
            self.terms.removeKey(k)
        yield pd.DataFrame([(k[0], 0) for k in gone], columns=["token", "df"])

    def close(self) -> None:
        pass


def running(tokens: DataFrame, buckets: int = 64, idle_ms: int | None = None) -> DataFrame:
    """A stream of (token), one row for each document that holds it -> (token, df) as they change, 0 when a term expires."""
    spark = tokens.sparkSession
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = tokens.where("token is not null").select("token", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"))
    return keyed.groupBy("bucket").transformWithStateInPandas(Frequencies(idle_ms), OUT, "Update", "processingTime" if idle_ms else "none")


def keep(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changes appended to a table as they come, with the number of their batch; a batch that is repeated replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """The last frequency of each term, expired ones left out."""
    return changes.groupBy("token").agg(F.max_by("df", "batch").alias("df")).where("df > 0")

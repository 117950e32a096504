"""The serving limits as Structured Streaming operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.serving import LIMIT, SPAN, admit


def stream_limiter(requests: DataFrame, limit: int = LIMIT, span: float = SPAN) -> DataFrame:
    """A stream (client, id, t) with ``admitted``; the state of a client is its admitted times, at most ``limit``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
        rows["admitted"] = admit(rows["t"].tolist(), recent, limit, span)
        state.update((list(recent),))
        yield rows[["client", "id", "t", "admitted"]]

    return requests.groupBy("client").applyInPandasWithState(run, "client long, id long, t double, admitted boolean", "recent array<double>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window with a watermark (an extension: the batch engine has no windows of its own)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A query that appends each batch's new keys to a table: an exact-match result cache."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

"""An extension: the delta of each snapshot that lands in a store, against its predecessor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import delta as dl
from ..operators import history
from ..schema import Snapshots


def watch(spark: SparkSession, store: str, landed: str, out: str, checkpoint: str, deltas: Callable[[Snapshots, DataFrame], DataFrame] = dl.edges) -> StreamingQuery:
    """``landed`` gets JSON lines (snapshot_id, seq) once a snapshot's tables are in ``store``; the pairs that each batch completes
    are appended to ``out``.  The order of all snapshots so far is read from ``landed``: one row for each."""
    schema = "snapshot_id string, seq long"

    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        order = own.read.schema(schema).json(landed)
        pairs = history.consecutive(order).join(batch.select("snapshot_id").withColumnRenamed("snapshot_id", "b"), "b", "left_semi").select("pair_id", "a", "b")
        deltas(Snapshots.read(own, store), pairs).write.mode("append").parquet(f"{out}/batch={batch_id}")

    return spark.readStream.schema(schema).json(landed).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()



"""Streams: incremental file intake, logs of state changes, merges of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvane.operators.merge import Policy, merge


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream: the checkpoint is the manifest of what was read."""
    return spark.readStream.schema(schema).format(kind).load(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works off what is there and stops; a restart goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merging_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, policy: Mapping[str, Policy], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink that merges each micro-batch into a snapshot under column policies."""

    def each(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch, key, policy, order).drop("written"), number)

    return each


def first_deliveries(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Each key once within the time a row may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def window_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per window of event time and columns; a window is given out once no row of it can still come."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def state_changes(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """``key, old, new`` of rows whose state is another than before; new keys have no old one."""
    a = before.select(F.col(key), F.col(state).alias("old"))
    b = after.select(F.col(key), F.col(state).alias("new"))
    return b.join(a, key, "left").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "old", "new")


def delivery_changes(deliveries: DataFrame, key: str, state: str, *, source: str = "source", number: str = "snapshot_no") -> DataFrame:
    """``source, number, key, old, new`` of every row whose state is another than in the delivery before; keys that one hasn't have no old state.

    The state of a key in a delivery is the greatest of its rows. Neighbours are the deliveries present, so a gap in the numbering is none; the first
    delivery of a source gives no rows, nor do rows with a null source, number or key.
    """
    rows = deliveries.where(F.col(source).isNotNull() & F.col(number).isNotNull() & F.col(key).isNotNull())
    line = Window.partitionBy(source).orderBy(number)
    before = rows.select(source, number).distinct().withColumn("__before", F.lag(number).over(line))
    own = Window.partitionBy(source, key).orderBy(number)
    states = rows.groupBy(source, key, number).agg(F.max(state).alias("new"))
    states = states.withColumn("__seen", F.lag(number).over(own)).withColumn("__old", F.lag("new").over(own))
    out = states.join(before.where("__before is not null"), [source, number])
    out = out.withColumn("old", F.when(F.col("__seen") == F.col("__before"), F.col("__old")))
    return out.where(~F.col("old").eqNullSafe(F.col("new"))).select(source, number, key, "old", "new")

"""Events by week as a stream, an extension beside the weekly report: event-time windows behind a watermark.

New files of a landing folder are counted into weeks that begin on Mondays. A week is given out once the watermark has
passed its end; rows that come later than that are not counted any more, all others are, in whatever files they come. With
every file read, all_weeks() gives the weeks that are still open as well, so it equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weeks of seven days from a Monday on.
WEEK, MONDAY = "7 days", "4 days"
LATE = "14 days"


def weeks(events: DataFrame) -> DataFrame:
    """week (its Monday), event_type, events and value of events (ts, event_type, user_id, value), batch or stream."""
    window = F.window("ts", WEEK, WEEK, MONDAY)
    grouped = events.where(F.col("ts").isNotNull()).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.col("value").cast("decimal(20,4)")), 2).cast("double").alias("value")).select(F.to_date("w.start").alias("week"), "event_type", "events", "value")


def closed_weeks(spark: SparkSession, landing: str, schema, table: str, checkpoint: str, late: str = LATE) -> None:
    """Read all files that have come since the last call, and append the weeks that the watermark has closed to table. A call that fails can be repeated."""
    rows = spark.readStream.schema(schema).parquet(landing).withWatermark("ts", late)
    out = weeks(rows).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()


def all_weeks(spark: SparkSession, landing: str, schema, checkpoint: str, late: str = LATE) -> DataFrame:
    """Every week, open or closed, of all files that have come: the state of the stream as each batch updates it, the last one of a week."""
    from ..shared import shared_folder

    rows = spark.readStream.schema(schema).parquet(landing).withWatermark("ts", late)
    folder = f"{shared_folder(spark)}/weeks-{checkpoint.rstrip('/').rpartition('/')[2]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = weeks(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("week date, event_type string, events long, value double, batch int").parquet(folder)
    return told.groupBy("week", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("last")).select("week", "event_type", "last.*")

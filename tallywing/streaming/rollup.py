"""Station hours as a stream: daily rollup with late data, and the cache fed by new files.

An extension beyond daily batches: the same registry decides sums and means.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(hours: DataFrame, how: Mapping[str, str], late: str = "2 days") -> DataFrame:
    """location, date and the daily values of a stream of hours (location, datetime, ...); hours later than `late` are left out."""
    aggs = [(F.coalesce(F.sum(v), F.lit(0.0)) if h == "sum" else F.avg(v)).alias(v) for v, h in how.items()]
    days = hours.withWatermark("datetime", late).groupBy("location", F.window("datetime", "1 day").alias("day")).agg(*aggs)
    return days.select("location", F.to_date(F.col("day.start")).alias("date"), *how)


def files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_once(days: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends the days that are complete to a Parquet folder, working off all files that are there, and stops."""
    return days.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Streams over the same operators: feed ingest, monthly growth, a request budget (extensions; batch semantics lead)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    """A folder of feed files as a stream."""
    return spark.readStream.schema(schema).format(kind).load(path)


def latest_claims(claims: DataFrame, delay: str = "1 day") -> DataFrame:
    """The newest value of each (bin, field) and day in event time, ties to the greater id; the state of a day past is let go."""
    return claims.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 day"), "bin_id", "field").agg(F.max_by("value", F.struct("observed_at", "id")).alias("value"))


def monthly_growth(rows: DataFrame, delay: str = "31 days") -> DataFrame:
    """Prefixes first seen in each 30-day window."""
    return rows.withColumn("first_seen", F.col("first_seen").cast("timestamp")).withWatermark("first_seen", delay).groupBy(F.window("first_seen", "30 days")).agg(F.count(F.lit(1)).alias("added"))


def request_budget(requests: DataFrame, per_hour: int = 5) -> DataFrame:
    """(window, source, requests, within): requests of each hour, and whether they kept to the budget."""
    counts = requests.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour"), "source").agg(F.count(F.lit(1)).alias("requests"))
    return counts.withColumn("within", F.col("requests") <= per_hour)


def stage_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch; ``checkpoint`` is a shared folder."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that an aggregating stream gives for the input there is now, as a table under ``path``, a shared folder."""
    spark = stream.sparkSession

    def write(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")

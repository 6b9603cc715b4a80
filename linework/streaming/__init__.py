"""Conversion of image files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Profile, convert
from ..sources.images import SCHEMA


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files whose rows are images of the image schema."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def converted(rows: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Converted rows of a stream: the operator has no state, so any sink and trigger will do."""
    return convert(rows, profile)


def pass_rate(converted_rows: DataFrame, seconds: str = "1 minute") -> DataFrame:
    """How many images of each window passed, by arrival, with late rows dropped after a window's length."""
    timed = converted_rows.withColumn("at", F.current_timestamp()).withWatermark("at", seconds)
    return timed.groupBy(F.window("at", seconds).alias("w")).agg(F.count("*").alias("images"), F.count_if("passed").alias("passed"))

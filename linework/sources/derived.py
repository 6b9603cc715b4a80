"""Rasters and drawings derived from the plain tables, so that relational operators can be held against SQL.

raster: an image for each embeddings label; row y is the y-th vector by vec_id, column x its x-th entry.
paths: a path for each user's events in time order; x is the time, y the value, both in 0..1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64


#: Vectors whose vec_id // NUMBERED agree are numbered at once.
NUMBERED = 4096


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, embedding). Rows are numbered within ranges of vec_id, and each range begins where those before it end,
    which is known from their counts: an image's vectors are never sorted in one task."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").withColumn("part", F.floor(F.col("vec_id") / NUMBERED))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = e.groupBy("label", "part").agg(F.count("*").alias("n")).select("label", "part", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("label", "part").orderBy("vec_id")) - 1
    return e.withColumn("k", within).join(starts, ["label", "part"]).select(F.col("label").alias("image_id"), (F.col("start") + F.col("k")).cast("int").alias("y"), "embedding")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels (image_id, y, x, v)."""
    cells = _rows(spark, sf_dir).select("image_id", "y", F.posexplode("embedding").alias("x", "e"))
    value = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("e").cast("double") + 0.5) * 255)))
    return cells.select("image_id", "y", "x", value.cast("int").alias("v"))


def color_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels (image_id, y, x, b, g, r): the three channels are the raster shifted by 0, 21 and 42 columns."""
    value = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 0.5) * 255))).cast("int"))
    rows = _rows(spark, sf_dir).select("image_id", "y", value.alias("a"))
    channels = F.transform("a", lambda v, i: F.struct(v.alias("b"), F.get("a", (i + 21) % WIDTH).alias("g"), F.get("a", (i + 42) % WIDTH).alias("r")))
    return rows.select("image_id", "y", F.posexplode(channels).alias("x", "c")).select("image_id", "y", "x", "c.b", "c.g", "c.r")


def label_map(pixels: DataFrame) -> DataFrame:
    """labels (image_id, y, x, label): four bands of brightness."""
    return pixels.select("image_id", "y", "x", F.floor(F.col("v") / 64).cast("int").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path_id, i, x, y, closed, kind): ten users make an image, closed if the user's number is even, and
    kind boundary for every third user, else detail."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.floor(F.col("user_id") / 10).alias("image_id"),
        F.col("user_id").alias("path_id"),
        i.alias("i"),
        (seconds / F.lit(2592000.0)).alias("x"),
        (F.col("value") / F.lit(500.0)).alias("y"),
        (F.col("user_id") % 2 == 0).alias("closed"),
        F.when(F.col("user_id") % 3 == 0, "boundary").otherwise("detail").alias("kind"),
    )


#: The same in DuckDB's SQL.
RASTER_SQL = """raster AS (
  SELECT label AS image_id, y, x, CAST(floor(greatest(0.0, least(255.0, (CAST(embedding[x + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS v
  FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS y FROM embeddings) e,
       (SELECT CAST(unnest(range(64)) AS INTEGER) AS x) c)"""
COLOR_SQL = """color AS (
  SELECT label AS image_id, y, x, """ + ", ".join(f"CAST(floor(greatest(0.0, least(255.0, (CAST(embedding[(x + {shift}) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS {name}" for name, shift in (("b", 0), ("g", 21), ("r", 42))) + """
  FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS y FROM embeddings) e,
       (SELECT CAST(unnest(range(64)) AS INTEGER) AS x) c)"""
LABELS_SQL = RASTER_SQL + """, labels_ AS (SELECT image_id, y, x, CAST(floor(v / 64) AS INTEGER) AS label FROM raster)"""
POINTS_SQL = """points AS (
  SELECT user_id // 10 AS image_id, user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i,
    date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 2592000.0::DOUBLE AS x, value / 500.0 AS y,
    user_id % 2 = 0 AS closed, CASE WHEN user_id % 3 = 0 THEN 'boundary' ELSE 'detail' END AS kind FROM events)"""

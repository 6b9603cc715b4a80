"""Images as rows (image_id, height, width, n_channels, data): BGR bytes, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "image_id string, height int, width int, n_channels int, data binary, error_class string"


def read_images(spark: SparkSession, folder: str, prefix: str = "", recursive: bool = False) -> DataFrame:
    """The JPEG and PNG files of a folder. The key is the full path, so equal names in two folders or of two kinds stay
    apart. A file that cannot be decoded has error_class unsupported_image and no data."""
    glob = prefix + "*.{jpg,JPG,jpeg,JPEG,png,PNG}"
    read = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    bad = F.col("image.height") < 0
    return read.select(
        F.col("image.origin").alias("image_id"),
        *(F.when(~bad, F.col(f"image.{a}")).alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "n_channels"), ("data", "data"))),
        F.when(bad, "unsupported_image").alias("error_class"),
    )


def from_arrays(spark: SparkSession, arrays: dict) -> DataFrame:
    """Images in memory: arrays (h, w) or (h, w, 3) of uint8 by id."""
    rows = []
    for image_id, a in arrays.items():
        if a.dtype.name != "uint8" or a.ndim not in (2, 3) or a.ndim == 3 and a.shape[2] != 3:
            raise ValueError(f"{image_id}: an image is (h, w) or (h, w, 3) of uint8, not {a.shape} of {a.dtype}")
        rows.append((str(image_id), a.shape[0], a.shape[1], 1 if a.ndim == 2 else 3, bytearray(a.tobytes()), None))
    return spark.createDataFrame(rows, SCHEMA)


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Gray images of pixels (image_id, y, x, v) that fill their rectangle; an image becomes one row. Pixels are packed into
    bytes by image row first, so no array holds a struct for each pixel of an image."""
    bytes_of = lambda a: F.unhex(F.array_join(F.transform(a, lambda p: F.lpad(F.hex(p["v"]), 2, "0")), ""))
    rows = pixels.groupBy("image_id", "y").agg(F.max("x").alias("_w"), bytes_of(F.array_sort(F.collect_list(F.struct("x", "v")))).alias("_row"))
    packed = rows.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("_w").alias("_w"), F.array_sort(F.collect_list(F.struct("y", "_row"))).alias("_p"))
    data = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["_row"])), ""))
    return packed.select(F.col("image_id").cast("string").alias("image_id"), (F.col("_h") + 1).cast("int").alias("height"), (F.col("_w") + 1).cast("int").alias("width"), F.lit(1).alias("n_channels"), data.alias("data"), F.lit(None).cast("string").alias("error_class"))


def to_pixels(images: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, v) of gray images: rows are cut out of the bytes, then pixels out of rows, so no Python runs."""
    rows = images.where("n_channels = 1 and height > 0 and width > 0").select("image_id", "width", "data", F.explode(F.expr("sequence(0, height - 1)")).alias("y"))
    rows = rows.select("image_id", "y", F.hex(F.substring("data", F.col("y") * F.col("width") + 1, F.col("width"))).alias("h"), F.explode(F.expr("sequence(0, width - 1)")).alias("x"))
    return rows.select("image_id", "y", "x", F.conv(F.substring("h", F.col("x") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("v"))

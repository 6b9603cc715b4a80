"""Report grids, batch status and configuration as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Styles, whether they are recommended, and whether they need one worker.
STYLES = [("adaptive", False, False), ("anime2sketch", True, True), ("canny", True, False), ("cartoon", True, False), ("chained", False, False), ("gated", False, True), ("informative_drawings", True, True), ("lineart", True, True), ("lineart-raster", True, True), ("region", True, False), ("skeleton", True, False), ("xdog", False, False)]
STYLE_SCHEMA = "style string, recommended boolean, serial boolean"

#: A profile's fields and what a missing one is.
PROFILE_SCHEMA = "page struct<size: string, orientation: string, margin_mm: double, dpi: int, stroke_width_mm: double>, style string, detail string, device string, seed int, max_pixels long, debug_dir string"
DEFAULTS = {"style": "lineart-raster", "detail": "child", "device": "auto", "max_pixels": 40_000_000}


def literal_rows(rows: list[tuple], schema: str) -> Column:
    """Rows known to the program as an array of structs, to be exploded beside each row: no join, no broadcast."""
    fields = [x.split() for x in schema.split(", ")]
    return F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True))) for r in rows))


def grid(images: DataFrame, styles: list[tuple] = STYLES, schema: str = STYLE_SCHEMA) -> DataFrame:
    """Each image with each style."""
    return images.withColumn("_s", F.explode(literal_rows(styles, schema))).select(*images.columns, "_s.*")


def recommended(styles: DataFrame, left_out: list[str]) -> DataFrame:
    """All styles but those left out."""
    return styles.where(~F.col("style").isin(left_out))


def with_reference(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Images (image_id, aspect) beside their reference of the pairs (image_id, reference_id, reference_aspect), if any, and
    whether the aspects differ by more than 0.05."""
    return images.join(pairs, "image_id", "left").withColumn("aspect_mismatch", F.abs(F.col("aspect") - F.col("reference_aspect")) > 0.05)


def decision(row_ink: Column, dangling: Column, regions: Column) -> Column:
    """3 to 8 % ink, no loose end, 40 to 400 regions."""
    return row_ink.between(0.03, 0.08) & (dangling == 0) & regions.between(40, 400)


def batch_summary(status: DataFrame) -> DataFrame:
    """Counts of the batch status (error, passed_strict)."""
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("passed_strict")).alias("passed_strict"))


def timings_total(timings: Column) -> Column:
    """Sum of a map of seconds by stage."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, b: a + b)


def profiles(json: Column) -> Column:
    """A profile of JSON text by an explicit schema; missing fields take their defaults, bad JSON gives null."""
    p = F.from_json(json, PROFILE_SCHEMA)
    return F.when(p.isNotNull(), F.struct(p["page"].alias("page"), *(F.coalesce(p[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()), p["seed"].alias("seed"), p["debug_dir"].alias("debug_dir")))


def stage_funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """How many rows of each image survive each stage: (image_id, seq, stage, n). The images are those of any stage; where none
    of an image's rows survive, n is 0."""
    counted = reduce(DataFrame.unionByName, (df.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("seq", F.lit(seq)) for seq, (_, df) in enumerate(stages)))
    every = counted.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "n"))).alias("m"))  # one entry for each stage
    rows = every.withColumn("s", F.explode(literal_rows([(seq, name) for seq, (name, _) in enumerate(stages)], "seq int, stage string")))
    return rows.select("image_id", "s.seq", "s.stage", F.coalesce(F.try_element_at("m", F.col("s.seq")), F.lit(0).cast("long")).alias("n"))


def write_csv(metrics: DataFrame, folder: str) -> None:
    """Metrics with a header; nulls are blank."""
    metrics.write.mode("overwrite").option("header", True).option("nullValue", "").csv(folder)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of a report's rows for people to read; a report of more rows than ``most`` is refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a table of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in found])

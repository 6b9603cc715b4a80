"""Page geometry and sizes as column expressions. Lengths are in mm unless a name says px."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Page sizes in mm.
SIZES = {"A4": (210.0, 297.0), "A5": (148.0, 210.0), "LETTER": (215.9, 279.4)}


def mm_to_px(mm: Column, dpi: Column) -> Column:
    return mm * dpi / 25.4


def mm2_to_px2(mm2: Column, dpi: Column) -> Column:
    return mm2 * (dpi / 25.4) * (dpi / 25.4)


def page_sizes(specs: DataFrame) -> DataFrame:
    """width_mm and height_mm of (size, orientation); an unknown size has null and an error_class."""
    w = F.coalesce(*(F.when(F.upper("size") == k, v[0]) for k, v in SIZES.items()))
    h = F.coalesce(*(F.when(F.upper("size") == k, v[1]) for k, v in SIZES.items()))
    wide = F.col("orientation") == "landscape"
    out = specs.select("*", F.when(wide, h).otherwise(w).alias("width_mm"), F.when(wide, w).otherwise(h).alias("height_mm"))
    return out.withColumn("error_class", F.when(w.isNull(), "unknown_page_size").when((F.col("margin_mm") * 2 >= F.col("width_mm")) | (F.col("margin_mm") * 2 >= F.col("height_mm")), "margins_too_large"))


def usable(width: Column, height: Column, margin: Column) -> tuple[Column, Column]:
    return width - 2 * margin, height - 2 * margin


def fit(aspect: Column, width: Column, height: Column, margin: Column) -> tuple[Column, Column, Column]:
    """scale, offset x and offset y that letterbox an image of that aspect (width / height) into the usable page; points
    are shares of the longer side, so one scale serves both axes."""
    uw, uh = usable(width, height, margin)
    cw, ch = F.when(aspect >= 1, 1.0).otherwise(aspect), F.when(aspect >= 1, 1.0 / aspect).otherwise(1.0)
    scale = F.least(uw / cw, uh / ch)
    return scale, (width - cw * scale) / 2, (height - ch * scale) / 2


def content_area(aspect: Column, scale: Column) -> Column:
    """Area of the placed image."""
    return F.when(aspect >= 1, scale * scale / aspect).otherwise(scale * scale * aspect)


def kernel_size(dimension: Column, fraction: float, least: int = 3, odd: bool = True) -> Column:
    """Share of a dimension, rounded half to even, at least ``least`` and odd if asked."""
    n = F.greatest(F.bround(dimension * fraction).cast("int"), F.lit(least))
    return F.when((n % 2 == 0), n + 1).otherwise(n) if odd else n


def line_thickness(dimension: Column) -> Column:
    return F.greatest(F.bround(dimension / 700.0).cast("int"), F.lit(1))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Long side by short side."""
    return F.greatest(width, height) / F.least(width, height)

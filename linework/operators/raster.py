"""Relational operators on pixels (image_id, y, x, v): measures, stencils, labels.

Stencils are lag and lead over a row, then over a column, so a pixel is never joined with its
neighbours. Pixels are dealt by image once, which serves the windows of rows and of columns alike; an
image is bounded by the size check. Borders mirror without repeating the edge pixel unless an operator says otherwise.
Values are 0 to 255; ink is dark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


# --- measures


def ink_coverage(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """Share of pixels darker than ``dark``."""
    return pixels.groupBy("image_id").agg(F.avg((F.col("v") < dark).cast("int")).alias("ink_coverage"))


def antialiased_fraction(pixels: DataFrame, low: int = 5, high: int = 250) -> DataFrame:
    """Share of pixels strictly between ``low`` and ``high``."""
    return pixels.groupBy("image_id").agg(F.avg(((F.col("v") > low) & (F.col("v") < high)).cast("int")).alias("antialiased_fraction"))


def passed(ink: tuple[float, float] = (0.03, 0.08), leaking: int = 0, dangling: int = 0, area: float = 1.0, antialiased: float = 0.05) -> Column:
    """Whether a quality report's row passes; a measure that is null does not count. Never null itself."""
    free = lambda name, rule: F.col(name).isNull() | F.coalesce(rule, F.lit(False))
    return (
        F.coalesce(F.col("ink_coverage").between(*ink), F.lit(False))
        & free("leaking_regions", F.col("leaking_regions") <= leaking)
        & free("dangling_endpoints", F.col("dangling_endpoints") <= dangling)
        & free("min_region_area_mm2", F.col("min_region_area_mm2") >= area)
        & free("antialiased_fraction", F.col("antialiased_fraction") >= antialiased)
    )


def quality_report(pixels: DataFrame) -> DataFrame:
    """The measures of a raster that need no neighbourhood, in one pass, and the gate."""
    out = pixels.groupBy("image_id").agg(
        F.avg((F.col("v") < 128).cast("int")).alias("ink_coverage"),
        F.avg(((F.col("v") > 5) & (F.col("v") < 250)).cast("int")).alias("antialiased_fraction"),
        F.count("*").alias("n_pixels"),
    )
    absent = {"leaking_regions": "int", "dangling_endpoints": "int", "min_region_area_mm2": "double"}
    return out.withColumns({k: F.lit(None).cast(t) for k, t in absent.items()}).withColumn("passed", passed()).drop(*absent)


def percentiles(pixels: DataFrame, shares: list[float], value: str = "v") -> DataFrame:
    """Exact percentiles, linear between ranks: columns p0, p1, ..."""
    return pixels.groupBy("image_id").agg(*(F.percentile(value, s).alias(f"p{i}") for i, s in enumerate(shares)))


def size_check(images: DataFrame, most: int = 40_000_000) -> DataFrame:
    """Images by height and width with error_class, null for those that may be converted."""
    return images.withColumn("error_class", F.when(F.col("height").cast("long") * F.col("width") > most, "image_too_large"))


# --- single pixels


def stretched(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Contrast between two percentiles of the image to 0..255, truncated; a flat image becomes white."""
    bounds = percentiles(pixels, [low, high])
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - F.col("p0")) / (F.col("p1") - F.col("p0")) * 255))
    return pixels.join(bounds, "image_id").select("image_id", "y", "x", F.when(F.col("p1") <= F.col("p0"), 255).otherwise(v.cast("int")).alias("v"))


def inverted(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", 255 - F.col("v"))


def gamma(pixels: DataFrame, exponent: float) -> DataFrame:
    """v to the power ``exponent`` on a scale of 0..1, truncated."""
    return pixels.withColumn("v", (F.pow(F.col("v") / F.lit(255.0), F.lit(exponent)) * 255).cast("int"))


def gray(color: DataFrame) -> DataFrame:
    """0.299 r + 0.587 g + 0.114 b, rounded half up."""
    return color.select("image_id", "y", "x", F.floor(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r") + 0.5).cast("int").alias("v"))


def lab(color: DataFrame) -> DataFrame:
    """CIE Lab (D65) of sRGB channels: l in 0..100, a and b* about 0 (named la, lb)."""

    def linear(c: str) -> Column:
        s = F.col(c) / F.lit(255.0)
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = linear("r"), linear("g"), linear("b")

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)

    x = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return color.select("*", (116 * y - 16).alias("l"), (500 * (x - y)).alias("la"), (200 * (y - z)).alias("lb"))


def soft_threshold(pixels: DataFrame, epsilon: float, phi: float, value: str = "v") -> DataFrame:
    """White at or above epsilon, below it 1 + tanh(phi (v - epsilon)), clipped and put on 0..255."""
    t = F.when(F.col(value) >= epsilon, 1.0).otherwise(1 + F.tanh(phi * (F.col(value) - epsilon)))
    return pixels.withColumn("v", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 255).cast("int"))


# --- stencils


def by_image(pixels: DataFrame) -> DataFrame:
    """Each image in one partition: one shuffle for any number of windows over rows and columns."""
    return pixels.repartition("image_id")


def _mirrored(value: Column, over) -> tuple[Column, Column]:
    before, after = F.lag(value).over(over), F.lead(value).over(over)
    return F.coalesce(before, after, value), F.coalesce(after, before, value)


def sobel(pixels: DataFrame, value: str = "v") -> DataFrame:
    """gx, gy and energy gx^2 + gy^2 of the 3 x 3 Sobel stencil."""
    left, right = _mirrored(F.col(value), along_row())
    rows = by_image(pixels).select("image_id", "y", "x", (right - left).alias("d"), (left + 2 * F.col(value) + right).alias("s"))
    d_up, d_down = _mirrored(F.col("d"), along_column())
    s_up, s_down = _mirrored(F.col("s"), along_column())
    out = rows.select("image_id", "y", "x", (d_up + 2 * F.col("d") + d_down).alias("gx"), (s_down - s_up).alias("gy"))
    return out.withColumn("energy", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))


def box(pixels: DataFrame, radius: int, what=F.avg, value: str = "v", out: str = "box") -> DataFrame:
    """A separable aggregate (avg of sums, min or max) over squares of 2 radius + 1, cut off at the border. Pixels should
    be dealt by_image()."""
    over = lambda w: w.rowsBetween(-radius, radius)
    if what is F.avg:
        rows = pixels.select("*", F.sum(value).over(over(along_row())).alias("_s"), F.count(value).over(over(along_row())).alias("_n"))
        return rows.select(*pixels.columns, (F.sum("_s").over(over(along_column())) / F.sum("_n").over(over(along_column()))).alias(out))
    return pixels.withColumn("_m", what(value).over(over(along_row()))).withColumn(out, what("_m").over(over(along_column()))).drop("_m")


def adaptive_threshold(pixels: DataFrame, block: int = 9, c: float = 2) -> DataFrame:
    """255 where a pixel is lighter than its block's mean less c, else 0."""
    return box(by_image(pixels), block // 2).select("image_id", "y", "x", F.when(F.col("v") > F.col("box") - c, 255).otherwise(0).alias("v"))


def dilated(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return box(by_image(pixels), radius, F.max).select("image_id", "y", "x", F.col("box").alias("v"))


def eroded(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return box(by_image(pixels), radius, F.min).select("image_id", "y", "x", F.col("box").alias("v"))


def closed(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return box(dilated(pixels, radius), radius, F.min).select("image_id", "y", "x", F.col("box").alias("v"))


def morphological_gradient(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Largest less smallest value of the square."""
    both = box(box(by_image(pixels), radius, F.max, out="hi"), radius, F.min, out="lo")
    return both.select("image_id", "y", "x", (F.col("hi") - F.col("lo")).alias("v"))


def neighbor_counts(mask: DataFrame, value: str = "v") -> DataFrame:
    """For pixels whose value is not 0, how many of the eight neighbours are not 0 either."""
    on = (F.col(value) != 0).cast("int")
    three = lambda w: w.rowsBetween(-1, 1)
    rows = by_image(mask).select("image_id", "y", "x", on.alias("on"), F.sum(on).over(three(along_row())).alias("s"))
    return rows.withColumn("n", F.sum("s").over(three(along_column())) - F.col("on")).where("on = 1").select("image_id", "y", "x", "n")


def shrunk(pixels: DataFrame, factor: int) -> DataFrame:
    """Area means over squares of ``factor``, rounded half up; a rest at the border makes smaller ones."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.floor(F.avg("v") + 0.5).cast("int").alias("v"))


def sampled(pixels: DataFrame, factor: int) -> DataFrame:
    """Nearest: each factor-th pixel of each factor-th row; right for label maps."""
    return pixels.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).select("image_id", (F.col("y") / factor).cast("int").alias("y"), (F.col("x") / factor).cast("int").alias("x"), *[c for c in pixels.columns if c not in ("image_id", "y", "x")])


# --- labels


def color_labels(color: DataFrame, step: int = 4) -> DataFrame:
    """Regions of equal quantised colour; numbers follow the order of (b, g, r) within the image."""
    quantised = [F.floor(F.col(c) / step) for c in ("b", "g", "r")]
    q = color.select("*", *(c.alias(f"q{i}") for i, c in enumerate(quantised)))
    # ranks are made of the distinct colours, which are few, not by sorting all pixels
    kinds = q.select("image_id", "q0", "q1", "q2").distinct()
    kinds = kinds.withColumn("label", F.dense_rank().over(Window.partitionBy("image_id").orderBy("q0", "q1", "q2")) - 1)
    return q.join(kinds, ["image_id", "q0", "q1", "q2"]).select("image_id", "y", "x", "label", "b", "g", "r")


def mean_per_label(labels: DataFrame, *values: str) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(*(F.avg(v).alias(f"mean_{v}") for v in values), F.count("*").alias("area"))


def boundary(labels: DataFrame) -> DataFrame:
    """Pixels of which one of the four neighbours has another label, on both sides of the edge."""
    differs = [F.coalesce(f("label").over(w) != F.col("label"), F.lit(False)) for w in (along_row(), along_column()) for f in (F.lag, F.lead)]
    flagged = by_image(labels).withColumn("_row", differs[0] | differs[1]).withColumn("_edge", F.col("_row") | differs[2] | differs[3])
    return flagged.where("_edge").drop("_row", "_edge")


def adjacency(labels: DataFrame) -> DataFrame:
    """Distinct unordered pairs of labels that touch along a side: (a, b), a < b."""
    pairs = by_image(labels).select("image_id", "label", F.lead("label").over(along_row()).alias("right"), F.lead("label").over(along_column()).alias("down"))
    pairs = pairs.select("image_id", "label", F.explode(F.array("right", "down")).alias("other")).where("other <> label")
    return pairs.select("image_id", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def contrast_filter(labels: DataFrame, means: DataFrame, least: float, values: list[str]) -> DataFrame:
    """Boundary pixels that lie beside a region whose mean differs by at least ``least``. ``means`` has mean_<value> of
    each label. Neighbouring labels are compared once for each pair, not for each pixel."""
    near = [f("label").over(w) for w in (along_row(), along_column()) for f in (F.lag, F.lead)]
    seen = by_image(labels).select("image_id", "y", "x", "label", F.array(*near).alias("near")).select("image_id", "y", "x", "label", F.explode(F.array_distinct("near")).alias("other")).where("other <> label")
    a = means.select("image_id", F.col("label"), *(F.col(f"mean_{v}").alias(f"a_{v}") for v in values))
    b = means.select("image_id", F.col("label").alias("other"), *(F.col(f"mean_{v}").alias(f"b_{v}") for v in values))
    apart = F.sqrt(reduce(lambda x, y: x + y, ((F.col(f"a_{v}") - F.col(f"b_{v}")) ** 2 for v in values)))
    touching = seen.select("image_id", "label", "other").distinct()
    strong = touching.join(a, ["image_id", "label"]).join(b, ["image_id", "other"]).where(apart >= least).select("image_id", "label", "other")
    return seen.join(strong, ["image_id", "label", "other"]).select("image_id", "y", "x", "label").distinct()


def smallest_mask(masks: DataFrame) -> DataFrame:
    """Of the masks (image_id, mask_id, area, y, x) that cover a pixel the smallest has it; equal areas: the larger number,
    which would be painted last."""
    return masks.groupBy("image_id", "y", "x").agg(F.min_by("mask_id", F.struct("area", -F.col("mask_id"))).alias("mask_id"))


def merge_small_regions(labels: DataFrame, value: str, least: int, rounds: int = 20, cut=kept) -> DataFrame:
    """Regions smaller than ``least`` pixels join the touching region of the nearest mean, all of a round at once, until
    none is small or has a neighbour. Ties go to the lowest label. Two regions that choose each other both take the lower
    label; otherwise they would only swap names for ever. Rounds work on the graph of regions, whose sums and
    neighbours are made once; pixels are read for that and for the final names only. ``cut`` (a function of a
    frame) keeps lineage short."""
    sums = cut(labels.groupBy("image_id", "label").agg(F.sum(value).alias("s"), F.count("*").alias("n")))
    pairs = cut(adjacency(labels))
    names = sums.select("image_id", "label", F.col("label").alias("root"))
    for _ in range(rounds):
        root = lambda side: names.select("image_id", F.col("label").alias(side), F.col("root").alias(f"{side}_root"))
        regions = sums.join(names, ["image_id", "label"]).groupBy("image_id", "root").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
        touching = pairs.join(root("a"), ["image_id", "a"]).join(root("b"), ["image_id", "b"]).where("a_root <> b_root")
        both = touching.select("image_id", F.explode(F.array(F.struct(F.col("a_root").alias("x"), F.col("b_root").alias("y")), F.struct(F.col("b_root").alias("x"), F.col("a_root").alias("y")))).alias("p")).select("image_id", "p.x", "p.y")
        small = regions.where(F.col("n") < least).select("image_id", F.col("root").alias("x"), F.col("mean").alias("own"))
        near = both.join(small, ["image_id", "x"]).join(regions.select("image_id", F.col("root").alias("y"), "mean"), ["image_id", "y"])
        to = cut(near.groupBy("image_id", "x").agg(F.min_by("y", F.struct(F.abs(F.col("own") - F.col("mean")), F.col("y"))).alias("to")))
        if to.isEmpty():
            break
        its = to.select("image_id", F.col("x").alias("to"), F.col("to").alias("back"))
        to = to.join(its, ["image_id", "to"], "left").select("image_id", F.col("x").alias("root"), F.when(F.col("back") == F.col("x"), F.least("x", "to")).otherwise(F.col("to")).alias("to"))
        names = cut(names.join(to, ["image_id", "root"], "left").select("image_id", "label", F.coalesce("to", "root").alias("root")))
    return labels.join(names, ["image_id", "label"]).withColumn("label", F.col("root")).drop("root").select(*labels.columns)


def within_labels(pixels: DataFrame, kept: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, label, ...) whose label is among the kept ones (image_id, label)."""
    return pixels.join(kept.select("image_id", "label").distinct(), ["image_id", "label"], "left_semi")


def pair_area(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """source_area of pairs of labels (image_id, a, b): the smaller region's share of the image."""
    own = areas.select("image_id", F.col("label").alias("a"), F.col("area").alias("area_a"))
    its = areas.select("image_id", F.col("label").alias("b"), F.col("area").alias("area_b"))
    whole = areas.groupBy("image_id").agg(F.sum("area").alias("whole"))
    return pairs.join(own, ["image_id", "a"]).join(its, ["image_id", "b"]).join(whole, "image_id").withColumn("source_area", F.least("area_a", "area_b") / F.col("whole")).drop("area_a", "area_b", "whole")


def zonal_confidence(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """255 less the mean value under each zone (image_id, path_id, y, x); a zone without a pixel has 0."""
    found = zones.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    return found.groupBy("image_id", "path_id").agg(F.coalesce(255 - F.avg("v"), F.lit(0.0)).alias("confidence"))

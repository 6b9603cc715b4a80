"""Relational operators on points (image_id, path_id, i, x, y, closed, kind) and on paths made of them.

Coordinates are shares of the image's longer side. A path's points are numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import literal_rows

PATH = ["image_id", "path_id"]


def whole():
    return Window.partitionBy(*PATH)


def in_order():
    return whole().orderBy("i")


def path_length(points: DataFrame) -> DataFrame:
    """length of each path, its closing segment included if it is closed, with n_points, closed and kind. The steps between
    points are summed as they come from the sort, so no path is gathered into an array."""
    step = lambda x, y: F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    rows = points.withColumn("_step", step(F.lag("x").over(in_order()), F.lag("y").over(in_order())))
    end = lambda f: f(F.struct("x", "y"), F.col("i"))
    sums = rows.groupBy(*PATH).agg(F.first("closed").alias("closed"), F.first("kind").alias("kind"), F.count("*").cast("int").alias("n_points"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_open"), end(F.min_by).alias("_a"), end(F.max_by).alias("_b"))
    back = F.sqrt((F.col("_a.x") - F.col("_b.x")) ** 2 + (F.col("_a.y") - F.col("_b.y")) ** 2)
    return sums.select(*PATH, "closed", "kind", "n_points", (F.col("_open") + F.when(F.col("closed"), back).otherwise(0.0)).alias("length"))


def bounds(points: DataFrame) -> DataFrame:
    """Smallest and largest coordinates of each image; an image without points has no row."""
    return points.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def where_paths(points: DataFrame, paths: DataFrame) -> DataFrame:
    """The points of the given paths."""
    return points.join(paths.select(*PATH).distinct(), PATH, "left_semi")


def length_filter(points: DataFrame, least: float) -> DataFrame:
    """The points of the paths of at least that length."""
    return where_paths(points, path_length(points).where(F.col("length") >= least))


#: Thresholds of the detail presets, in mm (and pixels for the resolution).
DETAIL = [("toddler", 300.0, 6.0, 1.0, 512), ("child", 120.0, 3.0, 0.6, 768), ("adult", 25.0, 1.5, 0.3, 1280)]
DETAIL_SCHEMA = "detail string, min_region_area_mm2 double, min_stroke_length_mm double, simplify_epsilon_mm double, raster_resolution int"


def detail_filter(paths: DataFrame, scale_mm: Column, content_area_mm2: Column, presets: list[tuple] = DETAIL) -> DataFrame:
    """Paths (length, source_area as shares) that are long and large enough for each preset on a page; a path without an
    area passes that test, and without content area the test is left out."""
    joined = paths.withColumn("_d", F.explode(literal_rows(presets, DETAIL_SCHEMA)))
    long_enough = F.col("length") >= F.col("_d.min_stroke_length_mm") / scale_mm
    large_enough = F.col("source_area").isNull() | (content_area_mm2 <= 0) | (F.col("source_area") >= F.col("_d.min_region_area_mm2") / content_area_mm2)
    return joined.where(long_enough & large_enough).select(*paths.columns, "_d.detail")


def collinear_drop(points: DataFrame) -> DataFrame:
    """Without points equal to the one before, then without those that lie on the straight way between their
    neighbours. Of open paths the ends stay; a closed path that would fall under three points stays as it was."""
    same = (F.lag("x").over(in_order()) == F.col("x")) & (F.lag("y").over(in_order()) == F.col("y"))
    first = F.struct("x", "y")
    over = whole().orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumn("_n0", F.count("*").over(whole())).withColumn("_last", F.last(first).over(over))
    wraps = F.col("closed") & (F.lag("i").over(in_order()).isNull()) & (F.col("_last") == first) & (F.col("_n0") > 1)
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)) | wraps)
    rows = rows.withColumn("_distinct", F.sum((~F.col("_same")).cast("int")).over(whole()))
    small = (F.col("_n0") < 3) | (F.col("closed") & (F.col("_distinct") < 3))
    rows = rows.where(small | ~F.col("_same")).withColumn("_small", small | (F.col("_distinct") < 3))
    edge = lambda f: F.first(f).over(over)
    last = lambda f: F.last(f).over(over)
    px, py = F.coalesce(F.lag("x").over(in_order()), last("x")), F.coalesce(F.lag("y").over(in_order()), last("y"))
    nx, ny = F.coalesce(F.lead("x").over(in_order()), edge("x")), F.coalesce(F.lead("y").over(in_order()), edge("y"))
    rows = rows.withColumns({"_ix": F.col("x") - px, "_iy": F.col("y") - py, "_ox": nx - F.col("x"), "_oy": ny - F.col("y")})
    turns = (F.col("_ix") * F.col("_oy") != F.col("_iy") * F.col("_ox")) | (F.col("_ix") * F.col("_ox") + F.col("_iy") * F.col("_oy") <= 0)
    end = ~F.col("closed") & (F.lag("i").over(in_order()).isNull() | F.lead("i").over(in_order()).isNull())
    rows = rows.withColumn("_keep", F.col("_small") | turns | end)
    rows = rows.withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(whole()))
    return rows.where(F.col("_keep") | (F.col("closed") & (F.col("_kept") < 3))).select(*points.columns)


def chaikin(points: DataFrame, rounds: int = 1) -> DataFrame:
    """Corner cutting: each side gives its points at a quarter and at three quarters. Open paths keep their ends; paths
    under three points stay."""
    now = points
    for _ in range(rounds):
        over = whole().orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = now.withColumn("_n", F.count("*").over(whole())).withColumn("_next", F.coalesce(F.lead(F.struct("x", "y")).over(in_order()), F.when(F.col("closed"), F.first(F.struct("x", "y")).over(over))))
        mix = lambda t: F.struct((F.col("x") * (1 - t) + F.col("_next.x") * t).alias("x"), (F.col("y") * (1 - t) + F.col("_next.y") * t).alias("y"))
        own = F.struct("x", "y")
        cutting = F.when(F.col("_n") < 3, F.array(own)).when(F.col("closed"), F.array(mix(0.25), mix(0.75)))
        cutting = cutting.when(F.col("_next").isNull(), F.array(own)).when(F.lag("i").over(in_order()).isNull(), F.array(own, mix(0.25), mix(0.75))).otherwise(F.array(mix(0.25), mix(0.75)))
        rows = rows.withColumn("_cut", cutting).select(*now.columns, F.posexplode("_cut").alias("_k", "_p"))
        now = rows.withColumn("i", F.row_number().over(whole().orderBy("i", "_k")) - 1).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).select(*points.columns)
    return now


def drawing_metrics(points: DataFrame) -> DataFrame:
    """A row of path statistics for each image."""
    p = path_length(points)
    return p.groupBy("image_id").agg(
        F.count("*").alias("n_paths"),
        F.median("length").alias("median_length"),
        F.percentile("length", 0.9).alias("p90_length"),
        F.sum("length").alias("total_length"),
        F.sum(F.when(F.col("closed"), 0).otherwise(2)).alias("dangling_endpoints"),
        F.avg(F.col("closed").cast("int")).alias("closed_share"),
        F.avg("n_points").alias("points_per_path"),
    )


def along(points: DataFrame, step: float) -> DataFrame:
    """(image_id, path_id, x, y) of places along all segments, closing ones included, at most ``step`` apart, the points among them."""
    first = F.first(F.struct("x", "y")).over(in_order())
    after = F.coalesce(F.lead(F.struct("x", "y")).over(in_order()), F.when(F.col("closed"), first))
    rows = points.withColumn("_to", after).withColumn("_to", F.coalesce("_to", F.struct("x", "y")))
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("_to.x") - F.col("x")) ** 2 + (F.col("_to.y") - F.col("y")) ** 2) / F.lit(step)).cast("int"))
    rows = rows.withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_t", F.col("_k") / F.col("_n"))
    return rows.select(*PATH, *((F.col(c) + (F.col(f"_to.{c}") - F.col(c)) * F.col("_t")).alias(c) for c in ("x", "y")))


def isolated_endpoints(points: DataFrame, cell: float) -> DataFrame:
    """Ends of open paths in whose cell and the eight about it no other path passes. Segments count along their whole length, by
    places half a cell apart at most. A cell stands in for all of a path's places in it, and no pair of points is ever made."""
    cells = along(points, cell / 2).select(*PATH, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).distinct()
    by_cell = cells.groupBy("image_id", "cx", "cy").agg(F.min("path_id").alias("lo"), F.max("path_id").alias("hi"))
    ends = points.where("not closed").withColumn("_last", F.max("i").over(whole())).where("i = 0 or i = _last").select(*PATH, "i", "x", "y")
    near = ends.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.withColumns({"cx": F.floor(F.col("x") / cell) + F.col("dx"), "cy": F.floor(F.col("y") / cell) + F.col("dy")})
    met = near.join(by_cell, ["image_id", "cx", "cy"]).where("lo <> path_id or hi <> path_id").select(*PATH, "i").distinct()
    return ends.join(met, [*PATH, "i"], "left_anti").select(*PATH, "i")


def tolerance_match(predicted: DataFrame, reference: DataFrame, tolerance: int) -> DataFrame:
    """For pixels (image_id, y, x) of either side how many have one of the other within the tolerance, as precision,
    recall and F1. The disc of offsets is joined on equal places, so no range join arises."""
    disc = [(dy, dx) for dy in range(-tolerance, tolerance + 1) for dx in range(-tolerance, tolerance + 1) if dy * dy + dx * dx <= tolerance * tolerance]
    offsets = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc)))
    grown = lambda side: side.select("image_id", "y", "x", offsets.alias("o")).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    hits = lambda a, b, n: a.join(grown(b), ["image_id", "y", "x"], "left_semi").groupBy("image_id").agg(F.count("*").alias(n))
    sizes = predicted.groupBy("image_id").agg(F.count("*").alias("n_predicted")).join(reference.groupBy("image_id").agg(F.count("*").alias("n_reference")), "image_id", "full")
    out = sizes.join(hits(predicted, reference, "hit_predicted"), "image_id", "left").join(hits(reference, predicted, "hit_reference"), "image_id", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"precision": share("hit_predicted", "n_predicted"), "recall": share("hit_reference", "n_reference")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("image_id", "n_predicted", "n_reference", "precision", "recall", "f1")


def normalized_f1(f1: Column, floor: Column) -> Column:
    """f1 above what a degenerate drawing would get, as a share of what is left above it."""
    return F.when(floor >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f1 - floor) / (1 - floor))))


def hausdorff_near(points: DataFrame, threshold: float) -> DataFrame:
    """(image_id, boundary_id, detail_id) of the paths of the two kinds whose Hausdorff distance is below the threshold:
    each point of either has one of the other nearer than that. No side of the paths' boxes may then lie further apart, which
    leaves few pairs; of these the boundary's points are looked at, and the detail's only where all of those are near one."""
    ids = ["image_id", "boundary_id", "detail_id"]
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    cells = {"cx": F.floor(F.col("x") / threshold), "cy": F.floor(F.col("y") / threshold)}
    spread = lambda df: df.withColumn("o", around).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")

    sides = {"x": F.min("x"), "y": F.min("y"), "x1": F.max("x"), "y1": F.max("y"), "n": F.count("*")}
    boxes_ = points.groupBy(*PATH, "kind").agg(*(f.alias(n) for n, f in sides.items())).withColumns(cells)
    box = lambda kind: boxes_.where(F.col("kind") == kind).select("image_id", "cx", "cy", F.col("path_id").alias(f"{kind}_id"), *(F.col(n).alias(f"{kind}_{n}") for n in sides))
    pairs = box("boundary").join(spread(box("detail")), ["image_id", "cx", "cy"])
    for n in ("x", "y", "x1", "y1"):
        pairs = pairs.where(F.abs(F.col(f"boundary_{n}") - F.col(f"detail_{n}")) < threshold)

    def covered(pairs: DataFrame, one: str, other: str) -> DataFrame:
        """The pairs in which every point of the first path has one of the second near."""
        of = lambda kind: points.where(F.col("kind") == kind).select("image_id", F.col("path_id").alias(f"{kind}_id"), F.col("i").alias(f"{kind}_i"), F.col("x").alias(f"{kind}_px"), F.col("y").alias(f"{kind}_py"), *(v.alias(k) for k, v in cells.items()))
        own = pairs.join(of(one), ["image_id", f"{one}_id"])
        its = spread(pairs.select(*ids).join(of(other), ["image_id", f"{other}_id"]))
        apart = (F.col(f"{one}_px") - F.col(f"{other}_px")) ** 2 + (F.col(f"{one}_py") - F.col(f"{other}_py")) ** 2
        met = own.join(its, [*ids, "cx", "cy"]).where(apart < threshold * threshold)
        kept = [c for c in pairs.columns if c not in ids]
        points_met = met.groupBy(*ids, f"{one}_i").agg(*(F.first(c).alias(c) for c in kept))
        return points_met.groupBy(*ids).agg(F.count("*").alias("_met"), *(F.first(c).alias(c) for c in kept)).where(F.col("_met") == F.col(f"{one}_n")).drop("_met")

    pairs = pairs.select(*ids, "boundary_n", "detail_n")
    return covered(covered(pairs, "boundary", "detail"), "detail", "boundary").select(*ids)


def hausdorff_dedup(points: DataFrame, threshold: float) -> DataFrame:
    """Without the detail paths that lie strictly nearer than the threshold to a boundary path."""
    near = hausdorff_near(points, threshold).select("image_id", F.col("detail_id").alias("path_id")).distinct()
    return points.join(near, PATH, "left_anti")


def boxes(points: DataFrame, cell: float) -> DataFrame:
    """Occupied cells of each image with the number of points and paths in them."""
    return points.groupBy("image_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("n_points"), F.count_distinct("path_id").alias("n_paths"))


def svg_paths(points: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """d attributes in mm with three decimals, rounded half up: M, then L for each further point, Z if closed."""
    number = lambda v: F.format_string("%.3f", F.floor(v * 1000 + 0.5) / 1000.0)
    place = F.concat(number(F.col("x") * scale + dx), F.lit(","), number(F.col("y") * scale + dy))
    rows = points.groupBy(*PATH).agg(F.array_sort(F.collect_list(F.struct("i", place.alias("p")))).alias("a"), F.first("closed").alias("closed"))
    return rows.select(*PATH, F.concat(F.lit("M"), F.array_join(F.transform("a", lambda s: s["p"]), " L"), F.when(F.col("closed"), " Z").otherwise("")).alias("d"))

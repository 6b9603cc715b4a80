"""Queries that need whole images or paths: arrays in Arrow batches. Some have SQL all the same; the rest are held against
fixtures in the tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate, kernels, styles
from ..operators import raster as rop
from ..sources.derived import RASTER_SQL, color_raster, label_map, raster
from ..sources.images import from_pixels, to_pixels
from . import compare, engine
from .recursive_sql import parts, stairless, thinned, walked

QUERIES = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def each_image(images: DataFrame, schema: str, f) -> DataFrame:
    """Rows that f(image_id, gray array) gives for each gray image."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(f(r["image_id"], np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return images.select("image_id", "height", "width", "data").mapInArrow(run, schema)


def _images(spark, d) -> DataFrame:
    return from_pixels(raster(spark, d))


def _pixel_rows(image_id, a):
    y, x = np.indices(a.shape)
    return zip([image_id] * a.size, y.ravel().tolist(), x.ravel().tolist(), a.ravel().tolist(), strict=True)


@query(f"WITH {RASTER_SQL} SELECT image_id::VARCHAR AS image_id, y, x, v FROM raster")
def image_round_trip(spark, d):
    """Pixels packed into images and taken apart again."""
    return to_pixels(_images(spark, d))


@query(f"""WITH {RASTER_SQL}, off AS (SELECT a - 5 AS dy, b - 5 AS dx FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b)),
  cand AS (SELECT image_id, (y + dy)::INT AS y, (x + dx)::INT AS x, dy * dy + dx * dx AS q FROM raster, off WHERE v < 48 AND dy * dy + dx * dx <= 25),
  best AS (SELECT image_id, y, x, min(q) AS q FROM cand GROUP BY 1, 2, 3)
  SELECT r.image_id::VARCHAR AS image_id, r.y, r.x, round(sqrt(q::DOUBLE), 6) AS distance FROM raster r JOIN best USING (image_id, y, x)""")
def distance_transform(spark, d):
    """Exact distance of paper to ink up to 5 pixels."""

    def f(image_id, a):
        dist = kernels.distance(a >= 48)
        return (r for r in _pixel_rows(image_id, np.round(dist, 6)) if r[3] <= 5)

    return each_image(_images(spark, d), "image_id string, y int, x int, distance double", f)


@query(f"""WITH {RASTER_SQL}, ink AS (SELECT image_id, y, x FROM raster WHERE v < 48)
  SELECT r.image_id::VARCHAR AS image_id, r.y, r.x, round(sqrt(min((r.y - i.y) * (r.y - i.y) + (r.x - i.x) * (r.x - i.x))::DOUBLE), 6) AS distance FROM raster r LEFT JOIN ink i ON r.image_id = i.image_id GROUP BY 1, 2, 3""")
def distance_map(spark, d):
    """Exact distance of every pixel to ink, null in an image without ink."""

    def f(image_id, a):
        dist = kernels.distance(a >= 48)
        return ((*r[:3], r[3] if np.isfinite(r[3]) else None) for r in _pixel_rows(image_id, np.round(dist, 6)))

    return each_image(_images(spark, d), "image_id string, y int, x int, distance double", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, ink AS (SELECT image_id, y, x, y * 64 + x AS id FROM raster WHERE v < 24),
  near AS (SELECT a.image_id, a.id AS a, b.id AS b FROM ink a JOIN ink b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
  reach AS (SELECT image_id, id AS a, id AS b FROM ink UNION SELECT r.image_id, r.a, n.b FROM reach r JOIN near n ON r.image_id = n.image_id AND r.b = n.a),
  comp AS (SELECT image_id, a, min(b) AS root FROM reach GROUP BY 1, 2), size AS (SELECT image_id, root, count(*) AS n FROM comp GROUP BY 1, 2)
  SELECT image_id::VARCHAR AS image_id, count(*) AS n_components, max(n) AS largest, sum(n)::BIGINT AS ink FROM size GROUP BY 1""")
def connected_components(spark, d):
    """Components of dark pixels over eight neighbours."""

    def f(image_id, a):
        labels, n = kernels.components(a < 24)
        size = np.bincount(labels.ravel(), minlength=n + 1)[1:]
        return [(image_id, n, int(size.max()), int(size.sum()))] if n else []

    return each_image(_images(spark, d), "image_id string, n_components long, largest long, ink long", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, weak AS (SELECT image_id, y, x, v FROM raster WHERE v <= 70),
  reach AS (SELECT image_id, y, x FROM weak WHERE v <= 30 UNION SELECT w.image_id, w.y, w.x FROM reach r JOIN weak w ON w.image_id = r.image_id AND w.y BETWEEN r.y - 1 AND r.y + 1 AND w.x BETWEEN r.x - 1 AND r.x + 1)
  SELECT r.image_id::VARCHAR AS image_id, count(*) FILTER (v <= 30) AS n_strong, count(*) FILTER (v <= 70) AS n_weak, any_value(coalesce(k.n, 0)) AS n_kept FROM raster r LEFT JOIN (SELECT image_id, count(*) AS n FROM reach GROUP BY 1) k USING (image_id) GROUP BY r.image_id""")
def hysteresis(spark, d):
    """Pixels of weak components with a strong pixel."""
    return each_image(_images(spark, d), "image_id string, n_strong long, n_weak long, n_kept long", lambda i, a: [(i, int((a <= 30).sum()), int((a <= 70).sum()), int(kernels.joined(a <= 30, a <= 70).sum()))])


@query(f"""WITH RECURSIVE {RASTER_SQL}, paper AS (SELECT image_id, y, x, y * 64 + x AS id FROM raster WHERE v >= 90), size AS (SELECT image_id, max(y) AS h FROM raster GROUP BY 1),
  out AS (SELECT p.image_id, p.y, p.x FROM paper p JOIN size s USING (image_id) WHERE y = 0 OR x = 0 OR x = 63 OR y = h
    UNION SELECT p.image_id, p.y, p.x FROM out o JOIN paper p ON p.image_id = o.image_id AND p.y BETWEEN o.y - 1 AND o.y + 1 AND p.x BETWEEN o.x - 1 AND o.x + 1 AND abs(p.y - o.y) + abs(p.x - o.x) = 1),
  inner_ AS (SELECT * FROM paper p WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.image_id = p.image_id AND o.y = p.y AND o.x = p.x)),
  near AS (SELECT a.image_id, a.id AS a, b.id AS b FROM inner_ a JOIN inner_ b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
  reach AS (SELECT image_id, id AS a, id AS b FROM inner_ UNION SELECT r.image_id, r.a, n.b FROM reach r JOIN near n ON r.image_id = n.image_id AND r.b = n.a),
  part AS (SELECT image_id, root, count(*) AS n FROM (SELECT image_id, a, min(b) AS root FROM reach GROUP BY 1, 2) GROUP BY 1, 2)
  SELECT s.image_id::VARCHAR AS image_id, count(root) AS n_regions, coalesce(sum(n), 0)::BIGINT AS area, round(quantile_cont(n, 0.05), 6) AS area_p5 FROM size s LEFT JOIN part USING (image_id) GROUP BY s.image_id""")
def enclosed_regions(spark, d):
    """Regions of paper that ink shuts in, and their areas."""

    def f(i, a):
        areas = gate._areas(a < 90)
        return [(i, len(areas), int(areas.sum()), round(float(np.percentile(areas, 5)), 6) if len(areas) else None)]

    return each_image(_images(spark, d), "image_id string, n_regions long, area long, area_p5 double", f)


@query()
def thinning(spark, d):
    """Pixels of the ink, its skeleton, and the skeleton without stairs and short branches."""

    def f(i, a):
        ink = a < 80
        thin = kernels.thin(ink)
        lean = kernels.without_stairs(thin)
        return [(i, int(ink.sum()), int(thin.sum()), int(lean.sum()), int(kernels.prune_branches(lean, 6).sum()))]

    return each_image(_images(spark, d), "image_id string, n_ink long, n_thin long, n_lean long, n_pruned long", f)


@query()
def traced_paths(spark, d):
    """Centre lines of the ink as paths, simplified."""

    def f(i, a):
        for n, (p, closed) in enumerate(kernels.trace(a < 60)):
            yield i, n, len(p), len(kernels.simplify(p, 1.2 / max(a.shape), closed)), bool(closed), round(kernels.path_length(p, closed), 6)

    return each_image(_images(spark, d), "image_id string, path_id long, n_points long, n_simplified long, closed boolean, length double", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, {parts("part", "SELECT image_id, y, x FROM raster WHERE v < 128")},
  size AS (SELECT image_id, root, greatest(max(y) - min(y), max(x) - min(x)) + 1 AS extent, count(*) AS n FROM part WHERE NOT moving GROUP BY 1, 2),
  m AS (SELECT image_id, count(*) AS c, median(extent)::DOUBLE AS e, sum(n) FILTER (extent < 4) / sum(n)::DOUBLE AS noise FROM size GROUP BY 1)
  SELECT r.image_id::VARCHAR AS image_id, round(avg((v < 128)::INT), 6) AS ink_coverage, coalesce(any_value(c), 0) AS component_count, coalesce(any_value(e), 0)::DOUBLE AS median_stroke_length, round(coalesce(any_value(noise), 0), 6) AS noise_fraction FROM raster r LEFT JOIN m USING (image_id) GROUP BY r.image_id""")
def line_metrics(spark, d):
    """Ink share, components, median extent, noise share."""

    def f(i, a):
        m = gate.line_metrics(a)
        return [(i, round(m["ink_coverage"], 6), m["component_count"], m["median_stroke_length"], round(m["noise_fraction"], 6))]

    return each_image(_images(spark, d), "image_id string, ink_coverage double, component_count long, median_stroke_length double, noise_fraction double", f)


def _thin_within(a: str, b: str) -> str:
    """The share of an image's pixels of ``a`` with one of ``b`` within two pixels."""
    return f"(SELECT image_id, avg((EXISTS (SELECT 1 FROM {b} q WHERE q.image_id = p.image_id AND (q.y - p.y) * (q.y - p.y) + (q.x - p.x) * (q.x - p.x) <= 4))::INT) AS s FROM {a} p GROUP BY 1)"


_F1 = lambda p, r: f"CASE WHEN coalesce({p}, 0) + coalesce({r}, 0) > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


@query(f"""WITH RECURSIVE {RASTER_SQL}, {thinned("ta", "SELECT image_id, y, x FROM raster WHERE v < 60")}, {thinned("tb", "SELECT image_id, y, 63 - x AS x FROM raster WHERE v < 60")}, {thinned("tc", "SELECT image_id, y, x FROM raster")},
  a AS (SELECT image_id, y, x FROM ta WHERE idle = 2), b AS (SELECT image_id, y, x FROM tb WHERE idle = 2), c AS (SELECT image_id, y, x FROM tc WHERE idle = 2),
  ink AS (SELECT image_id, avg((v < 60)::INT) AS ink FROM raster GROUP BY 1),
  scores AS (SELECT ink.image_id, ink, coalesce(p.s, 0) AS p, coalesce(r.s, 0) AS r, {_F1("p.s", "r.s")} AS f, {_F1("cp.s", "cr.s")} AS floor_
    FROM ink LEFT JOIN {_thin_within("a", "b")} p USING (image_id) LEFT JOIN {_thin_within("b", "a")} r USING (image_id) LEFT JOIN {_thin_within("c", "b")} cp USING (image_id) LEFT JOIN {_thin_within("b", "c")} cr USING (image_id))
  SELECT image_id::VARCHAR AS image_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, round(CASE WHEN floor_ >= 1 THEN 0 ELSE greatest(0, least(1, (f - floor_) / (1 - floor_))) END, 6) AS f1_normalized, ink BETWEEN 0.03 AND 0.07 AS ink_admissible FROM scores""")
def boundary_scores(spark, d):
    """Each image against its mirror image."""

    def f(i, a):
        m = gate.compare_boundaries(a, a[:, ::-1], 2, 60)
        return [(i, *(round(m[k], 6) for k in ("precision", "recall", "f1", "f1_normalized")), m["ink_admissible"])]

    return each_image(_images(spark, d), 'image_id string, precision double, recall double, f1 double, f1_normalized double, ink_admissible boolean', f)


@query()
def raster_validation(spark, d):
    """The whole quality gate of the derived rasters on a small page."""
    page = gate.Page(size=(60.0, 80.0), margin_mm=5.0, dpi=60)

    def f(i, a):
        r = gate.validate(styles.Raster(a, a.shape[1] / a.shape[0]), page)
        return [(i, r.ink_coverage, r.enclosed_regions, r.min_region_area_mm2, r.region_area_mm2_p5, r.antialiased_fraction, r.passed)]

    return each_image(_images(spark, d), "image_id string, ink_coverage double, enclosed_regions long, min_region_area_mm2 double, region_area_mm2_p5 double, antialiased_fraction double, passed boolean", f)


@query()
def smoothing(spark, d):
    """Mean absolute change by each smoother."""

    def f(i, a):
        g = a.astype(float)
        b3 = np.dstack([g, g, g])
        yield i, *(round(float(np.abs(s - g).mean()), 6) for s in (kernels.gaussian(g, 1.5), kernels.bilateral(g), kernels.l0_smooth(g), kernels.rolling_guidance(g), kernels.mean_shift(b3, 2, 20)[..., 0]))

    return each_image(_images(spark, d), "image_id string, gaussian double, bilateral double, l0 double, rolling double, mean_shift double", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, {thinned("thin", "SELECT image_id, y, x FROM raster WHERE v < 80")}, {stairless("bare", "SELECT image_id, y, x FROM thin WHERE idle = 2")},
  lean AS (SELECT image_id, y, x FROM bare WHERE idle = 4),
  count_ AS (SELECT a.image_id, a.y, a.x, count(*) - 1 AS n FROM lean a JOIN lean b ON b.image_id = a.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3),
  {parts("line", "SELECT * FROM lean")}, {parts("hub", "SELECT image_id, y, x FROM count_ WHERE n >= 3")},
  lines AS (SELECT image_id, count(DISTINCT root) AS lines FROM line WHERE NOT moving GROUP BY 1), hubs AS (SELECT image_id, count(DISTINCT root) AS hubs FROM hub WHERE NOT moving GROUP BY 1),
  counts AS (SELECT image_id, count(*) AS pixels, count(*) FILTER (n = 1) AS endpoints, count(*) FILTER (n >= 3) AS junctions FROM count_ GROUP BY 1)
  SELECT image_id::VARCHAR AS image_id, coalesce(pixels, 0) AS pixels, coalesce(endpoints, 0) AS endpoints, coalesce(junctions, 0) AS junctions, coalesce(hubs, 0) AS hubs, coalesce(lines, 0) AS lines
  FROM (SELECT DISTINCT image_id FROM raster) LEFT JOIN counts USING (image_id) LEFT JOIN hubs USING (image_id) LEFT JOIN lines USING (image_id)""")
def skeleton_metrics(spark, d):
    """Counts of the skeleton's pixels, ends and junctions."""

    def f(i, a):
        yield i, *kernels.skeleton_counts(a < 80).values()

    return each_image(_images(spark, d), "image_id string, pixels long, endpoints long, junctions long, hubs long, lines long", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, {parts("part", "SELECT * FROM raster", "v // 64", four=True)}
  SELECT image_id::VARCHAR AS image_id, kind::INT AS label, count(*) AS n_parts, sum(n)::BIGINT AS area, max(n) AS largest FROM (SELECT image_id, kind, root, count(*) AS n FROM part WHERE NOT moving GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def spatial_region_areas(spark, d):
    """Connected parts of each brightness band."""

    def f(i, a):
        by: dict[int, list[int]] = {}
        for label, area in kernels.spatial_regions(a.astype(int) // 64):
            by.setdefault(label, []).append(area)
        return [(i, label, len(v), sum(v), max(v)) for label, v in sorted(by.items())]

    return each_image(_images(spark, d), "image_id string, label int, n_parts long, area long, largest long", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, ink AS (SELECT image_id, y, x FROM raster WHERE v < 100), {parts("part", "SELECT * FROM ink")},
  starts AS (SELECT DISTINCT image_id, root FROM part WHERE NOT moving), {walked("walk", "ink", "starts")}
  SELECT image_id::VARCHAR AS image_id, row_number() OVER (PARTITION BY image_id ORDER BY root) - 1 AS contour_id, greatest(max(n), 1) AS n_points, round(max(length), 6) AS length FROM walk GROUP BY image_id, root""")
def outer_contours(spark, d):
    """Outer borders of the dark components."""

    def f(i, a):
        for n, c in enumerate(kernels.contours(a < 100)):
            yield i, n, len(c), round(kernels.path_length(c, True), 6)

    return each_image(_images(spark, d), "image_id string, contour_id long, n_points long, length double", f)


@query(f"""WITH {RASTER_SQL}, l AS (SELECT image_id, y, x, v, CAST(floor(v / 64) AS INTEGER) AS label FROM raster), n AS (SELECT image_id, label, count(*) AS area FROM l GROUP BY 1, 2), w AS (SELECT image_id, sum(area) AS whole FROM n GROUP BY 1)
  SELECT a.image_id, a.label AS a, b.label AS b, round(least(a.area, b.area) / whole::DOUBLE, 6) AS source_area FROM n a JOIN n b ON a.image_id = b.image_id AND a.label < b.label JOIN w ON w.image_id = a.image_id
  WHERE EXISTS (SELECT 1 FROM l p JOIN l q ON p.image_id = q.image_id AND ((p.y = q.y AND abs(p.x - q.x) = 1) OR (p.x = q.x AND abs(p.y - q.y) = 1)) WHERE p.image_id = a.image_id AND p.label = a.label AND q.label = b.label)""")
def pair_area(spark, d):
    """Touching brightness bands and the smaller one's share."""
    labels = label_map(raster(spark, d))
    areas = labels.groupBy("image_id", "label").agg(F.count("*").alias("area"))
    return rop.pair_area(rop.adjacency(labels), areas).withColumn("source_area", F.round("source_area", 6)).select("image_id", "a", "b", "source_area")


@query(f"""WITH {RASTER_SQL}, l AS (SELECT image_id, y, x, CAST(floor(v / 64) AS INTEGER) AS label FROM raster), big AS (SELECT image_id, label FROM l GROUP BY 1, 2 HAVING count(*) >= 700)
  SELECT image_id, label, y, x FROM l WHERE (image_id, label) IN (SELECT image_id, label FROM big)""")
def kept_region_mask(spark, d):
    """Pixels of the large bands."""
    labels = label_map(raster(spark, d))
    big = labels.groupBy("image_id", "label").agg(F.count("*").alias("n")).where("n >= 700")
    return rop.within_labels(labels, big).select("image_id", "label", "y", "x")


@query(f"""WITH {RASTER_SQL}, z AS (SELECT image_id, y // 8 AS path_id, y, x FROM raster WHERE x % 5 = 0) SELECT z.image_id, path_id::INT AS path_id, round(255 - avg(v), 6) AS confidence FROM z JOIN raster USING (image_id, y, x) GROUP BY 1, 2""")
def zonal_confidence(spark, d):
    """Darkness under zones of every fifth column."""
    p = raster(spark, d)
    zones = p.where("x % 5 = 0").select("image_id", F.floor(F.col("y") / 8).cast("int").alias("path_id"), "y", "x")
    return rop.zonal_confidence(p, zones).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {RASTER_SQL} SELECT image_id, (y // 8)::INT AS path_id, round(255 - avg(v), 6) AS confidence FROM raster GROUP BY 1, 2""")
def band_confidence(spark, d):
    """Darkness under zones of all pixels of eight rows."""
    p = raster(spark, d)
    zones = p.select("image_id", F.floor(F.col("y") / 8).cast("int").alias("path_id"), "y", "x")
    return rop.zonal_confidence(p, zones).withColumn("confidence", F.round("confidence", 6))


@query()
def style_comparison(spark, d):
    """The derived colour images in two styles, with the metrics of a comparison table."""
    page = gate.Page(size=(60.0, 80.0), margin_mm=5.0, dpi=60)
    return compare.compare(_color_images(spark, d), ["canny", "xdog"], engine.Profile(page=page, detail="adult"))


def _color_images(spark, d) -> DataFrame:
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    # row by row first, so that no task holds an image's pixels one by one
    rows = color_raster(spark, d).groupBy("image_id", "y").agg((F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("x", "b", "g", "r"))).alias("p"))
    rows = rows.select("image_id", "y", "width", F.unhex(F.array_join(F.transform("p", lambda p: F.concat(two(p["b"]), two(p["g"]), two(p["r"]))), "")).alias("data"))
    packed = rows.groupBy("image_id").agg((F.max("y") + 1).alias("height"), F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("y", "data"))).alias("rows"))
    data = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["data"])), ""))
    return packed.select(F.col("image_id").cast("string").alias("image_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(3).alias("n_channels"), data.alias("data"), F.lit(None).cast("string").alias("error_class"))


def _stub() -> dict:
    """Stands in for a network in queries and tests: dark where the image is."""
    return {"model": lambda rgb: 255 - kernels.to_gray(rgb[..., ::-1])}


def _styled(name: str, load=None):
    def f(spark, d):
        page = gate.Page(size=(60.0, 80.0), margin_mm=5.0, dpi=60)
        done = engine.convert(_color_images(spark, d), engine.Profile(page=page, style=name, detail="adult"), load)
        return done.select("image_id", "style", F.coalesce(F.size("paths"), F.lit(0)).alias("n_paths"), F.octet_length("raster").alias("raster_bytes"), "ink_coverage", "enclosed_regions", "passed", "error_class")

    f.__doc__ = f"The derived colour images in style {name}."
    return f


for _name in ("adaptive", "canny", "cartoon", "chained", "region", "skeleton", "xdog"):
    QUERIES[f"style_{_name}"] = (_styled(_name), None)
for _name in ("anime2sketch", "informative_drawings", "gated", "lineart-raster"):
    QUERIES[f"style_{_name.replace('-', '_')}"] = (_styled(_name, _stub), None)


@query()
def style_lineart(spark, d):
    """Segments from brightness bands stand in for the mask network."""

    def load():
        def masks(image):
            g = kernels.to_gray(image)
            return [(g < t, float((g < t).sum())) for t in (64, 128, 192, 256)]

        return _stub() | {"masks": masks}

    return _styled("lineart", load)(spark, d)

"""Queries on the derived paths, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import page
from ..operators import vector as op
from ..sources.derived import POINTS_SQL, RASTER_SQL, points, raster

QUERIES = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def tidy(df, *rounded):
    return df.withColumns({c: F.round(c, 6) for c in rounded})


LENGTH_SQL = POINTS_SQL + """, steps AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step,
    first_value(x) OVER p AS fx, first_value(y) OVER p AS fy, last_value(x) OVER p AS ex, last_value(y) OVER p AS ey FROM points
    WINDOW w AS (PARTITION BY path_id ORDER BY i), p AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  lengths AS (SELECT image_id, path_id, closed, kind, count(*)::INT AS n_points, coalesce(sum(step), 0) + CASE WHEN closed THEN any_value(sqrt(pow(fx - ex, 2) + pow(fy - ey, 2))) ELSE 0 END AS length
    FROM steps GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {LENGTH_SQL} SELECT image_id, path_id, closed, kind, n_points, round(length, 6) AS length FROM lengths")
def path_length(spark, d):
    return tidy(op.path_length(points(spark, d)), "length")


@query(f"WITH {POINTS_SQL} SELECT image_id, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM points GROUP BY 1")
def path_bounds(spark, d):
    return tidy(op.bounds(points(spark, d)), "x0", "y0", "x1", "y1")


@query(f"WITH {LENGTH_SQL} SELECT p.image_id, p.path_id, p.i, round(p.x, 6) AS x, round(p.y, 6) AS y FROM points p JOIN lengths l USING (image_id, path_id) WHERE l.length >= 7")
def length_filter(spark, d):
    return tidy(op.length_filter(points(spark, d), 7).select("image_id", "path_id", "i", "x", "y"), "x", "y")


@query(f"""WITH {LENGTH_SQL}, paths AS (SELECT *, CASE WHEN closed THEN length / 400 END AS source_area FROM lengths),
  presets AS (SELECT * FROM (VALUES ('toddler', 300.0, 6.0), ('child', 120.0, 3.0), ('adult', 25.0, 1.5)) t(detail, area, stroke))
  SELECT image_id, path_id, detail FROM paths, presets WHERE length >= stroke / 0.25 AND (source_area IS NULL OR source_area >= area / 3000.0)""")
def detail_filter(spark, d):
    """A page on which the image is 0.25 mm wide and 3000 mm2 large, so that each preset drops some paths."""
    paths = op.path_length(points(spark, d)).withColumn("source_area", F.when(F.col("closed"), F.col("length") / 400))
    return op.detail_filter(paths, F.lit(0.25), F.lit(3000.0)).select("image_id", "path_id", "detail")


#: A coarse grid brings about repeated and collinear points.
COARSE_SQL = POINTS_SQL + ", coarse AS (SELECT image_id, path_id, i, round(x * 20)::INT AS x, floor(y * 4)::INT AS y, closed FROM points)"


@query(f"""WITH {COARSE_SQL}, d0 AS (SELECT *, count(*) OVER p AS n0, lag(x) OVER w AS lx, lag(y) OVER w AS ly, last_value(x) OVER a AS ex, last_value(y) OVER a AS ey, row_number() OVER w AS k FROM coarse
    WINDOW p AS (PARTITION BY path_id), w AS (PARTITION BY path_id ORDER BY i), a AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  d1 AS (SELECT *, CASE WHEN k > 1 THEN x = lx AND y = ly ELSE closed AND n0 > 1 AND x = ex AND y = ey END AS same FROM d0),
  d2 AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY path_id) AS nd FROM d1),
  d3 AS (SELECT *, n0 < 3 OR nd < 3 AS small FROM d2 WHERE n0 < 3 OR (closed AND nd < 3) OR NOT same),
  d4 AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER a) AS px, coalesce(lag(y) OVER w, last_value(y) OVER a) AS py, coalesce(lead(x) OVER w, first_value(x) OVER a) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER a) AS ny,
      lag(i) OVER w IS NULL OR lead(i) OVER w IS NULL AS tip FROM d3
    WINDOW w AS (PARTITION BY path_id ORDER BY i), a AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  d5 AS (SELECT *, small OR (x - px) * (ny - y) <> (y - py) * (nx - x) OR (x - px) * (nx - x) + (y - py) * (ny - y) <= 0 OR (NOT closed AND tip) AS keep FROM d4),
  d6 AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY path_id) AS kept FROM d5) SELECT image_id, path_id, i, x, y FROM d6 WHERE keep OR (closed AND kept < 3)""")
def collinear_drop(spark, d):
    coarse = points(spark, d).select("image_id", "path_id", "i", F.round(F.col("x") * 20).cast("int").alias("x"), F.floor(F.col("y") * 4).cast("int").alias("y"), "closed")
    return op.collinear_drop(coarse).select("image_id", "path_id", "i", "x", "y")


@query(f"""WITH {POINTS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS c, coalesce(lead(x) OVER w, CASE WHEN closed THEN first_value(x) OVER a END) AS nx, coalesce(lead(y) OVER w, CASE WHEN closed THEN first_value(y) OVER a END) AS ny,
    row_number() OVER w AS k FROM points WINDOW w AS (PARTITION BY path_id ORDER BY i), a AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  cut AS (SELECT image_id, path_id, i, 0 AS part, x, y FROM n WHERE c < 3 OR (NOT closed AND (k = 1 OR nx IS NULL))
    UNION ALL SELECT image_id, path_id, i, 1, x * 0.75::DOUBLE + nx * 0.25::DOUBLE, y * 0.75::DOUBLE + ny * 0.25::DOUBLE FROM n WHERE c >= 3 AND nx IS NOT NULL
    UNION ALL SELECT image_id, path_id, i, 2, x * 0.25::DOUBLE + nx * 0.75::DOUBLE, y * 0.25::DOUBLE + ny * 0.75::DOUBLE FROM n WHERE c >= 3 AND nx IS NOT NULL)
  SELECT image_id, path_id, (row_number() OVER (PARTITION BY path_id ORDER BY i, part) - 1)::INT AS i, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(y * 1e6 + 0.5) / 1e6 AS y FROM cut""")
def chaikin_once(spark, d):
    out = op.chaikin(points(spark, d)).select("image_id", "path_id", "i", "x", "y")
    return out.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / F.lit(1e6) for c in ("x", "y")})


@query(f"WITH {LENGTH_SQL} SELECT image_id, sum(CASE WHEN closed THEN 0 ELSE 2 END)::BIGINT AS dangling_endpoints FROM lengths GROUP BY 1")
def dangling_endpoints(spark, d):
    return op.drawing_metrics(points(spark, d)).select("image_id", "dangling_endpoints")


@query(f"""WITH {LENGTH_SQL} SELECT image_id, count(*) AS n_paths, round(median(length), 5) AS median_length, round(quantile_cont(length, 0.9), 5) AS p90_length, round(sum(length), 5) AS total_length,
  sum(CASE WHEN closed THEN 0 ELSE 2 END)::BIGINT AS dangling_endpoints, round(avg(closed::INT), 6) AS closed_share, round(avg(n_points), 6) AS points_per_path FROM lengths GROUP BY 1""")
def drawing_metrics(spark, d):
    out = op.drawing_metrics(points(spark, d)).withColumns({c: F.round(c, 5) for c in ("median_length", "p90_length", "total_length")})
    return tidy(out, "closed_share", "points_per_path")


@query(f"""WITH {POINTS_SQL}, steps AS (SELECT *, coalesce(lead(x) OVER w, CASE WHEN closed THEN first_value(x) OVER w END, x) AS tx, coalesce(lead(y) OVER w, CASE WHEN closed THEN first_value(y) OVER w END, y) AS ty
    FROM points WINDOW w AS (PARTITION BY path_id ORDER BY i)),
  parts AS (SELECT *, greatest(1, ceil(sqrt(pow(tx - x, 2) + pow(ty - y, 2)) / 0.002::DOUBLE)::INT) AS n FROM steps),
  places AS (SELECT image_id, path_id, x + (tx - x) * (k / n::DOUBLE) AS x, y + (ty - y) * (k / n::DOUBLE) AS y FROM (SELECT *, unnest(range(n + 1)) AS k FROM parts)),
  cells AS (SELECT DISTINCT image_id, path_id, floor(x / 0.004::DOUBLE) AS cx, floor(y / 0.004::DOUBLE) AS cy FROM places),
  ends AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY path_id) AS e FROM points WHERE NOT closed) WHERE i = 0 OR i = e)
  SELECT image_id, path_id, i FROM ends WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.image_id = ends.image_id AND c.path_id <> ends.path_id AND abs(c.cx - floor(ends.x / 0.004::DOUBLE)) <= 1 AND abs(c.cy - floor(ends.y / 0.004::DOUBLE)) <= 1)""")
def isolated_endpoints(spark, d):
    return op.isolated_endpoints(points(spark, d), 0.004)


@query(f"""WITH {POINTS_SQL}, pairs AS (SELECT b.image_id, b.path_id AS boundary_id, d.path_id AS detail_id, b.i AS bi, d.i AS di, pow(b.x - d.x, 2) + pow(b.y - d.y, 2) AS q FROM points b JOIN points d ON b.image_id = d.image_id AND b.kind = 'boundary' AND d.kind = 'detail'),
  h AS (SELECT image_id, boundary_id, detail_id, max(q) AS q FROM (SELECT image_id, boundary_id, detail_id, min(q) AS q FROM pairs GROUP BY 1, 2, 3, bi UNION ALL SELECT image_id, boundary_id, detail_id, min(q) FROM pairs GROUP BY 1, 2, 3, di) GROUP BY 1, 2, 3)
  SELECT DISTINCT image_id, path_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.image_id = p.image_id AND h.detail_id = p.path_id AND h.q < 0.12 * 0.12)""")
def hausdorff_dedup(spark, d):
    return op.hausdorff_dedup(points(spark, d), 0.12).select("image_id", "path_id").distinct()


@query(f"""WITH {RASTER_SQL}, ink AS (SELECT * FROM raster WHERE v < 48), ref AS (SELECT image_id - 1 AS image_id, y, x FROM ink),
  hp AS (SELECT p.image_id, p.y, p.x FROM ink p WHERE EXISTS (SELECT 1 FROM ref r WHERE r.image_id = p.image_id AND r.y BETWEEN p.y - 2 AND p.y + 2 AND pow(r.y - p.y, 2) + pow(r.x - p.x, 2) <= 4)),
  hr AS (SELECT r.image_id, r.y, r.x FROM ref r WHERE EXISTS (SELECT 1 FROM ink p WHERE r.image_id = p.image_id AND r.y BETWEEN p.y - 2 AND p.y + 2 AND pow(r.y - p.y, 2) + pow(r.x - p.x, 2) <= 4)),
  n AS (SELECT image_id, (SELECT count(*) FROM ink p WHERE p.image_id = i.image_id) AS np, (SELECT count(*) FROM ref r WHERE r.image_id = i.image_id) AS nr, (SELECT count(*) FROM hp WHERE hp.image_id = i.image_id) AS kp, (SELECT count(*) FROM hr WHERE hr.image_id = i.image_id) AS kr
    FROM (SELECT image_id FROM ink UNION SELECT image_id FROM ref) i),
  f AS (SELECT image_id, np, nr, CASE WHEN np > 0 THEN kp / np ELSE 0 END AS p, CASE WHEN nr > 0 THEN kr / nr ELSE 0 END AS r FROM n)
  SELECT image_id, np AS n_predicted, nr AS n_reference, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM f""")
def tolerance_match(spark, d):
    """Ink of each image against that of the next one."""
    ink = raster(spark, d).where("v < 48").select(F.col("image_id").cast("bigint").alias("image_id"), "y", "x")
    return tidy(op.tolerance_match(ink, ink.withColumn("image_id", F.col("image_id") - 1), 2), "precision", "recall", "f1").withColumn("image_id", F.col("image_id").cast("int"))


@query(f"""WITH {POINTS_SQL} SELECT image_id, path_id, 'M' || string_agg(printf('%.3f', floor((x * 190 + 10) * 1000 + 0.5) / 1000) || ',' || printf('%.3f', floor((y * 190 + 43.5) * 1000 + 0.5) / 1000), ' L' ORDER BY i) || CASE WHEN closed THEN ' Z' ELSE '' END AS d FROM points GROUP BY image_id, path_id, closed""")
def svg_paths(spark, d):
    return op.svg_paths(points(spark, d), 190.0, 10.0, 43.5)


@query(f"WITH {POINTS_SQL} SELECT image_id, floor(x / 0.05::DOUBLE)::BIGINT AS cx, floor(y / 0.05::DOUBLE)::BIGINT AS cy, count(*) AS n_points, count(DISTINCT path_id) AS n_paths FROM points GROUP BY ALL")
def occupied_cells(spark, d):
    return op.boxes(points(spark, d), 0.05)


@query("""WITH specs AS (SELECT l_orderkey AS id, l_linenumber AS line, (['A4', 'A5', 'LETTER', 'B0'])[1 + l_orderkey % 4] AS size, CASE WHEN l_linenumber % 2 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation, l_quantity::DOUBLE AS margin_mm FROM lineitem),
  p AS (SELECT *, CASE size WHEN 'A4' THEN 210.0 WHEN 'A5' THEN 148.0 WHEN 'LETTER' THEN 215.9 END AS w, CASE size WHEN 'A4' THEN 297.0 WHEN 'A5' THEN 210.0 WHEN 'LETTER' THEN 279.4 END AS h FROM specs),
  o AS (SELECT size, orientation, margin_mm, CASE WHEN orientation = 'landscape' THEN h ELSE w END::DOUBLE AS width_mm, CASE WHEN orientation = 'landscape' THEN w ELSE h END::DOUBLE AS height_mm FROM p),
  f AS (SELECT *, least((width_mm - 2 * margin_mm) / 1.0, (height_mm - 2 * margin_mm) / (1 / 1.5::DOUBLE)) AS scale FROM o)
  SELECT size, orientation, CASE WHEN width_mm IS NULL THEN 'unknown_page_size' WHEN 2 * margin_mm >= width_mm OR 2 * margin_mm >= height_mm THEN 'margins_too_large' END AS error_class, count(*) AS n, round(avg(scale), 5) AS scale,
    round(avg((width_mm - scale) / 2), 5) AS offset_x, round(avg((height_mm - scale / 1.5::DOUBLE) / 2), 5) AS offset_y, round(avg(scale * scale / 1.5::DOUBLE), 4) AS area FROM f GROUP BY ALL""")
def page_fit(spark, d):
    """Line items as page specifications: a 3 by 2 image on pages of four sizes with margins of 1 to 50 mm."""
    specs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.get(F.array(*map(F.lit, ("A4", "A5", "LETTER", "B0"))), (F.col("l_orderkey") % 4).cast("int")).alias("size"), F.when(F.col("l_linenumber") % 2 == 0, "landscape").otherwise("portrait").alias("orientation"), F.col("l_quantity").cast("double").alias("margin_mm"))
    sized = page.page_sizes(specs)
    scale, dx, dy = page.fit(F.lit(1.5), F.col("width_mm"), F.col("height_mm"), F.col("margin_mm"))
    out = sized.select("size", "orientation", "error_class", scale.alias("scale"), dx.alias("dx"), dy.alias("dy"), page.content_area(F.lit(1.5), scale).alias("area"))
    return out.groupBy("size", "orientation", "error_class").agg(F.count("*").alias("n"), F.round(F.avg("scale"), 5).alias("scale"), F.round(F.avg("dx"), 5).alias("offset_x"), F.round(F.avg("dy"), 5).alias("offset_y"), F.round(F.avg("area"), 4).alias("area"))


@query("""SELECT p_size AS dimension, CASE WHEN greatest(round_even(p_size * 100 * 0.005::DOUBLE, 0)::INT, 3) % 2 = 0 THEN greatest(round_even(p_size * 100 * 0.005::DOUBLE, 0)::INT, 3) + 1 ELSE greatest(round_even(p_size * 100 * 0.005::DOUBLE, 0)::INT, 3) END AS kernel,
  greatest(round_even(p_size * 100 / 700.0::DOUBLE, 0)::INT, 1) AS thickness, round(p_size * 300 / 25.4::DOUBLE, 6) AS px, round(p_size * (300 / 25.4::DOUBLE) * (300 / 25.4::DOUBLE), 4) AS px2, count(*) AS n FROM part GROUP BY p_size""")
def size_functions(spark, d):
    """Kernel sizes, line widths and unit conversions of part sizes."""
    s = F.col("dimension")
    out = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_size").alias("dimension")).agg(F.count("*").alias("n"))
    return out.select("dimension", page.kernel_size(s * 100, 0.005).alias("kernel"), page.line_thickness(s * 100).alias("thickness"), F.round(page.mm_to_px(s, F.lit(300)), 6).alias("px"), F.round(page.mm2_to_px2(s, F.lit(300.0)), 4).alias("px2"), "n")


SCORES_SQL = dict((k, sql) for k, (_, sql) in QUERIES.items())["tolerance_match"]


@query(f"SELECT image_id, round(CASE WHEN image_id % 4 = 3 THEN 0 ELSE greatest(0, least(1, (f1 - (image_id % 4) / 4.0::DOUBLE) / (1 - (image_id % 4) / 4.0::DOUBLE))) END, 4) AS f1_normalized FROM ({SCORES_SQL})")
def f1_above_floor(spark, d):
    """F1 of tolerance_match above floors of 0, a quarter, a half and 1."""
    floor = F.when(F.col("image_id") % 4 == 3, 1.0).otherwise(F.col("image_id") % 4 / 4.0)
    return tolerance_match(spark, d).select("image_id", F.round(op.normalized_f1(F.col("f1"), floor), 4).alias("f1_normalized"))


@query(f"WITH {POINTS_SQL}, b AS (SELECT image_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM points GROUP BY 1) SELECT image_id, round(greatest(w, h) / least(w, h), 6) AS aspect_ratio FROM b ORDER BY image_id LIMIT 5")
def first_aspect_ratios(spark, d):
    """Longer by shorter side of the first five drawings in the order of their ids: a limit after a sort."""
    b = op.bounds(points(spark, d)).orderBy("image_id").limit(5)
    return b.select("image_id", F.round(page.aspect_ratio(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("aspect_ratio"))

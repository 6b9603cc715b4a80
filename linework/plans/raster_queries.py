"""Queries on the derived rasters, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as op
from ..sources.derived import COLOR_SQL, LABELS_SQL, RASTER_SQL, color_raster, label_map, raster

QUERIES = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def tidy(df, *rounded):
    return df.withColumns({c: F.round(c, 6) for c in rounded})


SOBEL_SQL = """, h AS (
  SELECT image_id, y, x, r - l AS d, l + 2 * v + r AS s FROM (
    SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w, v) AS l, coalesce(lead(v) OVER w, lag(v) OVER w, v) AS r
    FROM raster WINDOW w AS (PARTITION BY image_id, y ORDER BY x))), sobel AS (
  SELECT image_id, y, x, du + 2 * d + dd AS gx, sd - su AS gy FROM (
    SELECT *, coalesce(lag(d) OVER w, lead(d) OVER w, d) AS du, coalesce(lead(d) OVER w, lag(d) OVER w, d) AS dd,
      coalesce(lag(s) OVER w, lead(s) OVER w, s) AS su, coalesce(lead(s) OVER w, lag(s) OVER w, s) AS sd
    FROM h WINDOW w AS (PARTITION BY image_id, x ORDER BY y)))"""

BOX = "(PARTITION BY image_id, {0} ORDER BY {1} ROWS BETWEEN {2} PRECEDING AND {2} FOLLOWING)"


def box_sql(f: str, source: str, out: str, radius: int, value: str = "v") -> str:
    return f""", {out}_h AS (SELECT *, {f}({value}) OVER {BOX.format('y', 'x', radius)} AS m FROM {source}),
  {out} AS (SELECT image_id, y, x, {f}(m) OVER {BOX.format('x', 'y', radius)} AS v FROM {out}_h)"""


@query(f"WITH {RASTER_SQL} SELECT image_id, round(avg((v < 128)::INT), 6) AS ink_coverage FROM raster GROUP BY 1")
def ink_coverage(spark, d):
    return tidy(op.ink_coverage(raster(spark, d)), "ink_coverage")


@query(f"WITH {RASTER_SQL} SELECT image_id, round(avg((v > 5 AND v < 250)::INT), 6) AS antialiased_fraction FROM raster GROUP BY 1")
def antialiased_fraction(spark, d):
    return tidy(op.antialiased_fraction(raster(spark, d)), "antialiased_fraction")


@query(f"""WITH {RASTER_SQL} SELECT image_id, round(ink, 6) AS ink_coverage, round(aa, 6) AS antialiased_fraction, n AS n_pixels,
  ink BETWEEN 0.03 AND 0.08 AND aa >= 0.05 AS passed FROM
  (SELECT image_id, avg((v < 128)::INT) AS ink, avg((v > 5 AND v < 250)::INT) AS aa, count(*) AS n FROM raster GROUP BY 1)""")
def quality_gate(spark, d):
    return tidy(op.quality_report(raster(spark, d)), "ink_coverage", "antialiased_fraction")


@query(f"""WITH {RASTER_SQL} SELECT image_id, round(quantile_cont(v, 0.02), 6) AS p0, round(quantile_cont(v, 0.5), 6) AS p1,
  round(quantile_cont(v, 0.925), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p3 FROM raster GROUP BY 1""")
def percentiles(spark, d):
    return tidy(op.percentiles(raster(spark, d), [0.02, 0.5, 0.925, 0.98]), "p0", "p1", "p2", "p3")


@query(f"""WITH {RASTER_SQL}, sizes AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM raster GROUP BY 1)
  SELECT image_id, height::INT AS height, width::INT AS width, CASE WHEN height * width > 3000 THEN 'image_too_large' END AS error_class FROM sizes""")
def size_check(spark, d):
    sizes = raster(spark, d).groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return op.size_check(sizes, 3000)


@query(f"""WITH {RASTER_SQL}, b AS (SELECT image_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM raster GROUP BY 1)
  SELECT image_id, y, x, CASE WHEN hi <= lo THEN 255 ELSE trunc(greatest(0.0, least(255.0, (v - lo) / (hi - lo) * 255)))::INT END AS v FROM raster JOIN b USING (image_id)""")
def normalize_percentile(spark, d):
    return op.stretched(raster(spark, d))


@query(f"WITH {RASTER_SQL} SELECT image_id, y, x, trunc(pow((255 - v) / 255.0::DOUBLE, 0.625) * 255)::INT AS v FROM raster")
def invert_gamma(spark, d):
    return op.gamma(op.inverted(raster(spark, d)), 0.625)


@query(f"WITH {COLOR_SQL} SELECT image_id, y, x, floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5)::INT AS v FROM color")
def gray(spark, d):
    return op.gray(color_raster(spark, d))


@query(f"""WITH {COLOR_SQL}, lin AS (SELECT *, CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lr,
    CASE WHEN g / 255.0::DOUBLE <= 0.04045 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lg,
    CASE WHEN b / 255.0::DOUBLE <= 0.04045 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lb FROM color),
  xyz AS (SELECT image_id, (0.4124564::DOUBLE * lr + 0.3575761::DOUBLE * lg + 0.1804375::DOUBLE * lb) / 0.95047 AS x, 0.2126729::DOUBLE * lr + 0.7151522::DOUBLE * lg + 0.0721750::DOUBLE * lb AS y,
    (0.0193339::DOUBLE * lr + 0.1191920::DOUBLE * lg + 0.9503041::DOUBLE * lb) / 1.08883 AS z FROM lin),
  f AS (SELECT image_id, CASE WHEN x > 216.0::DOUBLE / 24389 THEN pow(x, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * x + 16) / 116 END AS x, CASE WHEN y > 216.0::DOUBLE / 24389 THEN pow(y, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * y + 16) / 116 END AS y,
    CASE WHEN z > 216.0::DOUBLE / 24389 THEN pow(z, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * z + 16) / 116 END AS z FROM xyz)
  SELECT image_id, round(avg(116 * y - 16), 4) AS l, round(avg(500 * (x - y)), 4) AS la, round(avg(200 * (y - z)), 4) AS lb FROM f GROUP BY 1""")
def lab_means(spark, d):
    return op.lab(color_raster(spark, d)).groupBy("image_id").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("l", "la", "lb")))


@query(f"""WITH {RASTER_SQL} SELECT image_id, y, x, trunc(greatest(0.0, least(1.0, CASE WHEN v / 255.0::DOUBLE >= 0.6 THEN 1.0 ELSE 1 + tanh(8 * (v / 255.0::DOUBLE - 0.6)) END)) * 255)::INT AS v FROM raster""")
def soft_threshold(spark, d):
    return op.soft_threshold(raster(spark, d).withColumn("s", F.col("v") / F.lit(255.0)), 0.6, 8.0, "s").drop("s")


@query(f"WITH {RASTER_SQL}{SOBEL_SQL} SELECT image_id, y, x, gx, gy, gx * gx + gy * gy AS energy FROM sobel")
def sobel_energy(spark, d):
    return op.sobel(raster(spark, d))


@query(f"""WITH {RASTER_SQL}{SOBEL_SQL}, e AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE) AS m FROM sobel), t AS (SELECT image_id, quantile_cont(m, 0.925) AS high FROM e GROUP BY 1)
  SELECT image_id, round(high, 6) AS high, round(0.4 * high, 6) AS low, count(*) FILTER (m >= high) AS strong, count(*) FILTER (m >= 0.4 * high) AS weak FROM e JOIN t USING (image_id) GROUP BY 1, high""")
def gradient_threshold(spark, d):
    e = op.sobel(raster(spark, d)).withColumn("m", F.sqrt("energy"))
    t = op.percentiles(e, [0.925], "m").withColumnRenamed("p0", "high")
    out = e.join(t, "image_id").groupBy("image_id", "high").agg(F.count_if(F.col("m") >= F.col("high")).alias("strong"), F.count_if(F.col("m") >= 0.4 * F.col("high")).alias("weak"))
    return tidy(out.withColumn("low", 0.4 * F.col("high")), "high", "low")


@query(f"""WITH {RASTER_SQL}, hs AS (SELECT *, sum(v) OVER {BOX.format('y', 'x', 4)} AS s, count(v) OVER {BOX.format('y', 'x', 4)} AS n FROM raster),
  m AS (SELECT image_id, y, x, v, sum(s) OVER {BOX.format('x', 'y', 4)} / sum(n) OVER {BOX.format('x', 'y', 4)}::DOUBLE AS box FROM hs) SELECT image_id, y, x, CASE WHEN v > box - 2 THEN 255 ELSE 0 END AS v FROM m""")
def adaptive_threshold(spark, d):
    return op.adaptive_threshold(raster(spark, d))


@query(f"WITH {RASTER_SQL}{box_sql('max', 'raster', 'dil', 1)}{box_sql('min', 'dil', 'ero', 1)} SELECT image_id, y, x, v FROM ero")
def morph_close(spark, d):
    return op.closed(raster(spark, d))


@query(f"WITH {RASTER_SQL}{box_sql('max', 'raster', 'hi', 1)}{box_sql('min', 'raster', 'lo', 1)} SELECT hi.image_id, hi.y, hi.x, hi.v - lo.v AS v FROM hi JOIN lo USING (image_id, y, x)")
def morph_gradient(spark, d):
    return op.morphological_gradient(raster(spark, d))


@query(f"""WITH {RASTER_SQL}, m AS (SELECT image_id, y, x FROM raster WHERE v < 100) SELECT a.image_id, a.y, a.x, count(b.x)::BIGINT AS n FROM m a
  LEFT JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) <> (b.y, b.x) GROUP BY 1, 2, 3""")
def neighbor_counts(spark, d):
    return op.neighbor_counts(raster(spark, d).withColumn("v", (F.col("v") < 100).cast("int")))


@query(f"WITH {RASTER_SQL} SELECT image_id, y // 4 AS y, x // 4 AS x, floor(avg(v) + 0.5)::INT AS v FROM raster GROUP BY ALL")
def resize_area(spark, d):
    return op.shrunk(raster(spark, d), 4)


@query(f"WITH {LABELS_SQL} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, label FROM labels_ WHERE y % 2 = 0 AND x % 2 = 0")
def resize_nearest(spark, d):
    return op.sampled(label_map(raster(spark, d)), 2)


RANKED_SQL = COLOR_SQL + """, ranked AS (SELECT image_id, y, x, b, g, r, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY b // 64, g // 64, r // 64) - 1 AS INTEGER) AS label FROM color)"""


@query(f"WITH {RANKED_SQL} SELECT image_id, y, x, label FROM ranked")
def color_labels(spark, d):
    return op.color_labels(color_raster(spark, d), 64).select("image_id", "y", "x", "label")


@query(f"WITH {RANKED_SQL} SELECT image_id, label, round(avg(b), 6) AS mean_b, round(avg(g), 6) AS mean_g, round(avg(r), 6) AS mean_r, count(*) AS area FROM ranked GROUP BY 1, 2")
def mean_color_per_label(spark, d):
    return tidy(op.mean_per_label(op.color_labels(color_raster(spark, d), 64), "b", "g", "r"), "mean_b", "mean_g", "mean_r")


@query(f"WITH {LABELS_SQL}, ids AS (SELECT DISTINCT image_id, l AS label FROM labels_, (SELECT unnest(range(5))::INT AS l)) SELECT image_id, label, count(x) AS area FROM ids LEFT JOIN labels_ USING (image_id, label) GROUP BY 1, 2")
def label_area(spark, d):
    """Numbers without a pixel have area 0."""
    labels = label_map(raster(spark, d))
    ids = labels.select("image_id").distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return ids.join(labels.groupBy("image_id", "label").agg(F.count("*").alias("area")), ["image_id", "label"], "left").fillna(0, ["area"])


@query(f"WITH {LABELS_SQL} SELECT image_id, count(DISTINCT label) AS region_count FROM labels_ GROUP BY 1")
def region_count(spark, d):
    return label_map(raster(spark, d)).groupBy("image_id").agg(F.count_distinct("label").alias("region_count"))


NEAR_SQL = """, near AS (SELECT image_id, y, x, label, lag(label) OVER r AS n0, lead(label) OVER r AS n1, lag(label) OVER c AS n2, lead(label) OVER c AS n3 FROM labels_
  WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


@query(f"WITH {LABELS_SQL}{NEAR_SQL} SELECT image_id, y, x, label FROM near WHERE label <> n0 OR label <> n1 OR label <> n2 OR label <> n3")
def label_boundary(spark, d):
    return op.boundary(label_map(raster(spark, d)))


@query(f"WITH {LABELS_SQL}{NEAR_SQL} SELECT DISTINCT image_id, least(label, o) AS a, greatest(label, o) AS b FROM (SELECT image_id, label, unnest([n1, n3]) AS o FROM near) WHERE label <> o")
def label_adjacency(spark, d):
    return op.adjacency(label_map(raster(spark, d)))


@query(f"""WITH {LABELS_SQL}{NEAR_SQL}, means AS (SELECT image_id, l.label, avg(v) AS m FROM labels_ l JOIN raster USING (image_id, y, x) GROUP BY 1, 2),
  long AS (SELECT image_id, y, x, label, unnest([n0, n1, n2, n3]) AS o FROM near)
  SELECT DISTINCT long.image_id, y, x, long.label FROM long JOIN means a ON a.image_id = long.image_id AND a.label = long.label JOIN means b ON b.image_id = long.image_id AND b.label = long.o WHERE long.label <> o AND abs(a.m - b.m) >= 80""")
def contrast_filter(spark, d):
    pixels = raster(spark, d)
    labels = pixels.withColumn("label", F.floor(F.col("v") / 64).cast("int"))
    return op.contrast_filter(labels, op.mean_per_label(labels, "v"), 80, ["v"])


@query(f"""WITH {RASTER_SQL}, masks AS (SELECT image_id, y, x, m AS mask_id, count(*) OVER (PARTITION BY image_id, m) AS area FROM raster, (SELECT unnest(range(6)) AS m) WHERE v >= m * 20 AND (x + m) % 3 <> 0)
  SELECT image_id, y, x, arg_min(mask_id, area * 100 - mask_id) AS mask_id FROM masks GROUP BY 1, 2, 3""")
def smallest_mask(spark, d):
    """Overlapping masks made of brightness levels."""
    m = raster(spark, d).withColumn("mask_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))).where("v >= mask_id * 20 and (x + mask_id) % 3 <> 0").select("image_id", "y", "x", "mask_id")
    areas = m.groupBy("image_id", "mask_id").agg(F.count("*").alias("area"))
    return op.smallest_mask(m.join(areas, ["image_id", "mask_id"]))


def _merge_sql(source: str, out: str, least: int) -> str:
    return f""", {out}_m AS (SELECT image_id, label, avg(v) AS m, count(*) AS area FROM {source} GROUP BY 1, 2),
  {out}_n AS (SELECT image_id, y, x, label, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS n1, lead(label) OVER (PARTITION BY image_id, x ORDER BY y) AS n3 FROM {source}),
  {out}_p AS (SELECT DISTINCT image_id, label, o FROM (SELECT image_id, label, unnest([n1, n3]) AS o FROM {out}_n) WHERE label <> o),
  {out}_q AS (SELECT image_id, label, o FROM {out}_p UNION SELECT image_id, o, label FROM {out}_p),
  {out}_t AS (SELECT q.image_id, q.label, q.o, row_number() OVER (PARTITION BY q.image_id, q.label ORDER BY abs(a.m - b.m), q.o) AS k FROM {out}_q q
    JOIN {out}_m a ON a.image_id = q.image_id AND a.label = q.label JOIN {out}_m b ON b.image_id = q.image_id AND b.label = q.o WHERE a.area < {least}),
  {out}_u AS (SELECT t.image_id, t.label, CASE WHEN u.o = t.label THEN least(t.label, t.o) ELSE t.o END AS o FROM {out}_t t LEFT JOIN {out}_t u ON u.image_id = t.image_id AND u.label = t.o AND u.k = 1 WHERE t.k = 1),
  {out} AS (SELECT s.image_id, s.y, s.x, s.v, coalesce(t.o, s.label) AS label FROM {source} s LEFT JOIN {out}_u t ON t.image_id = s.image_id AND t.label = s.label)"""


MERGE_SQL = "".join(_merge_sql(f"merged{k}" if k else "fine", f"merged{k + 1}", 400) for k in range(6))


@query(f"WITH {RASTER_SQL}, fine AS (SELECT *, CAST(floor(v / 16) AS INTEGER) AS label FROM raster){MERGE_SQL} SELECT image_id, label, count(*) AS area FROM merged6 GROUP BY 1, 2")
def merge_small_regions(spark, d):
    """Until no region is small; the SQL has six rounds one after the other, more than are needed."""
    fine = raster(spark, d).withColumn("label", F.floor(F.col("v") / 16).cast("int"))
    return op.merge_small_regions(fine, "v", 400).groupBy("image_id", "label").agg(F.count("*").alias("area"))


BRIGHT_SQL = "least(255, v + 20 + 4 * image_id)"


@query(f"""WITH {RASTER_SQL} SELECT image_id, round(ink, 6) AS ink_coverage, round(aa, 6) AS antialiased_fraction, n AS n_pixels,
  ink BETWEEN 0.03 AND 0.08 AND aa >= 0.05 AS passed FROM
  (SELECT image_id, avg(({BRIGHT_SQL} < 128)::INT) AS ink, avg(({BRIGHT_SQL} > 5 AND {BRIGHT_SQL} < 250)::INT) AS aa, count(*) AS n FROM raster GROUP BY 1)""")
def quality_gate_bright(spark, d):
    """The gate of rasters made brighter, the more the higher their number, so that some pass."""
    return tidy(op.quality_report(raster(spark, d).withColumn("v", F.expr(BRIGHT_SQL))), "ink_coverage", "antialiased_fraction")

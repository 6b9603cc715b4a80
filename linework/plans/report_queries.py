"""Report, batch and configuration queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as rop
from ..operators import report as op
from ..operators import vector as vop
from ..sources.derived import POINTS_SQL, RASTER_SQL, points, raster
from .vector_queries import LENGTH_SQL

QUERIES = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


STYLES_SQL = "styles AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(r).lower()}, {str(q).lower()})" for s, r, q in op.STYLES) + ") t(style, recommended, serial))"


@query(f"""WITH {RASTER_SQL}, {STYLES_SQL}, q AS (SELECT image_id, avg((v < 128)::INT) AS ink, avg((v > 5 AND v < 250)::INT) AS aa FROM raster GROUP BY 1)
  SELECT image_id, style, serial, round(ink, 6) AS ink_coverage, round(aa, 6) AS antialiased_fraction, CASE WHEN image_id % 3 = 0 THEN NULL ELSE image_id + 1 END AS reference_id FROM q, styles WHERE recommended""")
def style_report_grid(spark, d):
    """Images by recommended styles; a third of the images have no reference."""
    q = rop.quality_report(raster(spark, d)).select("image_id", F.round("ink_coverage", 6).alias("ink_coverage"), F.round("antialiased_fraction", 6).alias("antialiased_fraction"))
    pairs = q.where("image_id % 3 <> 0").select("image_id", (F.col("image_id") + 1).alias("reference_id"))
    return op.grid(q).where("recommended").drop("recommended").join(pairs, "image_id", "left")


@query(f"WITH {STYLES_SQL} SELECT style FROM styles WHERE style NOT IN ('adaptive', 'gated', 'xdog', 'chained')")
def recommended_styles(spark, d):
    styles = spark.createDataFrame(op.STYLES, op.STYLE_SCHEMA)
    return op.recommended(styles, ["adaptive", "gated", "xdog", "chained"]).select("style")


@query("""WITH s AS (SELECT page_id, CASE WHEN length(html) > 3000 THEN 'image_too_large' WHEN page_id % 7 = 0 THEN 'unsupported_image' END AS error, CASE WHEN page_id % 2 = 0 THEN page_id % 4 = 0 END AS passed FROM pages)
  SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (passed) AS passed_strict FROM s""")
def batch_status(spark, d):
    status = spark.read.parquet(f"{d}/pages.parquet").select(F.when(F.length("html") > 3000, "image_too_large").when(F.col("page_id") % 7 == 0, "unsupported_image").alias("error"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 4 == 0).alias("passed_strict"))
    return op.batch_summary(status)


@query(f"""WITH {POINTS_SQL}, m AS (SELECT image_id, path_id, count(*) AS regions, any_value(CASE WHEN path_id % 5 = 0 THEN 2 ELSE 0 END) AS dangling, avg((y < 0.005::DOUBLE)::INT) AS ink FROM points GROUP BY 1, 2)
  SELECT image_id, path_id, ink BETWEEN 0.03 AND 0.08 AND dangling = 0 AND regions BETWEEN 40 AND 400 AS ok, regions FROM m""")
def decide_pass_fail(spark, d):
    """Each path as a drawing: its points are the regions, low ones the ink, and every fifth has loose ends."""
    m = points(spark, d).groupBy("image_id", "path_id").agg(F.count("*").alias("regions"), F.avg((F.col("y") < 0.005).cast("int")).alias("ink"))
    dangling = F.when(F.col("path_id") % 5 == 0, 2).otherwise(0)
    return m.select("image_id", "path_id", op.decision(F.col("ink"), dangling, F.col("regions")).alias("ok"), "regions")


@query("""WITH t AS (SELECT user_id, event_type, round(sum(value), 6) AS s FROM events GROUP BY 1, 2) SELECT user_id, round(sum(s), 4) AS total_s, count(*) AS n_stages FROM t GROUP BY 1""")
def timings_total(spark, d):
    """Seconds by stage as a map of each user's event values by type."""
    t = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("s"))
    m = t.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "s")))).alias("timings"))
    return m.select("user_id", F.round(op.timings_total(F.col("timings")), 4).alias("total_s"), F.size("timings").cast("bigint").alias("n_stages"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"style": "canny", "seed": ' || event_id || '}' WHEN 1 THEN '{"page": {"size": "A5", "dpi": 150}, "detail": "adult"}' WHEN 2 THEN '{}' ELSE '{"max_pixels": ' || event_id * 10 || ', "style": null}' END AS js FROM events)
  SELECT coalesce(js ->> '$.style', 'lineart-raster') AS style, coalesce(js ->> '$.detail', 'child') AS detail, js ->> '$.page.size' AS size, CAST(js ->> '$.page.dpi' AS INT) AS dpi, count(*) AS n, sum(CAST(coalesce(js ->> '$.max_pixels', '40000000') AS BIGINT))::BIGINT AS pixels, count(js ->> '$.seed') AS seeded FROM j GROUP BY ALL""")
def profile_json(spark, d):
    """Profiles written as JSON, some fields missing."""
    e = F.col("event_id")
    js = F.when(e % 4 == 0, F.concat(F.lit('{"style": "canny", "seed": '), e.cast("string"), F.lit("}"))).when(e % 4 == 1, '{"page": {"size": "A5", "dpi": 150}, "detail": "adult"}').when(e % 4 == 2, "{}").otherwise(F.concat(F.lit('{"max_pixels": '), (e * 10).cast("string"), F.lit(', "style": null}')))
    p = spark.read.parquet(f"{d}/events.parquet").select(op.profiles(js).alias("p")).select("p.*")
    return p.groupBy("style", "detail", F.col("page.size").alias("size"), F.col("page.dpi").alias("dpi")).agg(F.count("*").alias("n"), F.sum("max_pixels").alias("pixels"), F.count("seed").alias("seeded"))


@query(f"""WITH {LENGTH_SQL}, t AS (SELECT * FROM (VALUES (0, 'traced', 0.0, FALSE), (1, 'long', 7.0, FALSE), (2, 'closed', 7.0, TRUE), (3, 'longest', 10.0, TRUE)) t(seq, stage, least, only_closed))
  SELECT image_id, seq, stage, count(*) FILTER (length >= least AND (closed OR NOT only_closed)) AS n FROM lengths, t GROUP BY 1, 2, 3""")
def stage_funnel(spark, d):
    """Some images have no path that survives all stages."""
    traced = vop.path_length(points(spark, d))
    long = traced.where("length >= 7")
    return op.stage_funnel([("traced", traced), ("long", long), ("closed", long.where("closed")), ("longest", long.where("closed and length >= 10"))])


@query(f"""WITH {RASTER_SQL}, sizes AS (SELECT image_id, (max(x) + 1) / (max(y) + 1)::DOUBLE AS aspect FROM raster GROUP BY 1)
  SELECT a.image_id, round(a.aspect, 6) AS aspect, round(b.aspect, 6) AS reference_aspect, abs(a.aspect - b.aspect) > 0.05 AS aspect_mismatch FROM sizes a LEFT JOIN sizes b ON b.image_id = a.image_id + 1""")
def reference_pairs(spark, d):
    sizes = raster(spark, d).groupBy("image_id").agg(((F.max("x") + 1) / (F.max("y") + 1)).alias("aspect"))
    pairs = sizes.select((F.col("image_id") - 1).alias("image_id"), F.col("aspect").alias("reference_aspect"))
    return op.with_reference(sizes, pairs).withColumns({c: F.round(c, 6) for c in ("aspect", "reference_aspect")})


@query(f"""WITH {POINTS_SQL} SELECT kind, closed, count(DISTINCT path_id) AS n_paths, count(*) AS n_points FROM points GROUP BY 1, 2""")
def path_union(spark, d):
    """Boundaries and details as two drawings, put together again."""
    p = points(spark, d)
    both = p.where("kind = 'boundary'").unionByName(p.where("kind = 'detail'"), allowMissingColumns=True)
    return both.groupBy("kind", "closed").agg(F.count_distinct("path_id").alias("n_paths"), F.count("*").alias("n_points"))

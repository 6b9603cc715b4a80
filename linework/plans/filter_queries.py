"""Filters, edges and simplified paths, pixel by pixel and point by point, with SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import kernels
from ..sources.derived import POINTS_SQL, RASTER_SQL, points
from .kernel_queries import _images, _pixel_rows, each_image
from .recursive_sql import stairless, thinned

QUERIES = {}
PIXELS = "image_id string, y int, x int, v double"
#: Means of few whole numbers often lie midway between two decimals, where the last bit would decide; so they are moved a little.
NUDGE = 1.4142135e-7
SIZED = "sized AS (SELECT *, max(y) OVER (PARTITION BY image_id) AS h, 63 AS w FROM raster)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _mirrored(at: str, last: str) -> str:
    return f"(CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {last} THEN 2 * {last} - ({at}) ELSE {at} END)"


def _offsets(name: str, r: int) -> str:
    return f"{name} AS (SELECT unnest(range({-r}, {r + 1}))::INT AS d)"


def _blurred(name: str, source: str, sigma: float) -> str:
    """A normal blur, down and then along, the border mirrored."""
    r = max(1, int(np.ceil(3 * sigma)))
    one = lambda to, frm, c, last: f"{to} AS (SELECT a.image_id, a.y, a.x, a.h, a.w, sum(exp(-d * d / {2 * sigma * sigma}::DOUBLE) * b.v) / sum(exp(-d * d / {2 * sigma * sigma}::DOUBLE)) AS v FROM {frm} a, {name}_o JOIN {frm} b ON b.image_id = a.image_id AND b.y = {_mirrored('a.y + d', last) if c == 'y' else 'a.y'} AND b.x = {_mirrored('a.x + d', last) if c == 'x' else 'a.x'} GROUP BY ALL)"
    return ", ".join([_offsets(f"{name}_o", r), one(f"{name}_down", source, "y", "a.h"), one(name, f"{name}_down", "x", "a.w")])


def _joint(name: str, values: str, guide: str, r: int, color: float, space: float) -> str:
    """The joint bilateral filter in a disc."""
    both = guide if guide == values else f"(SELECT g.image_id, g.y, g.x, g.v, b.v AS value FROM {guide} g JOIN {values} b USING (image_id, y, x))"
    value = "v" if guide == values else "value"
    return f"""{name} AS (SELECT image_id, y, x, h, w, sum(k * value) / sum(k) AS v FROM (
    SELECT g.image_id, g.y, g.x, g.h, g.w, n.{value} AS value, exp(-(n.v - g.v) * (n.v - g.v) / {2 * color**2}::DOUBLE - q / {2 * space**2}::DOUBLE) AS k
    FROM (SELECT c.*, {_mirrored('y + dy', 'h')} AS ny, {_mirrored('x + dx', 'w')} AS nx, dy * dy + dx * dx AS q FROM {guide} c, (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range({-r}, {r + 1}))::INT AS d) a, (SELECT unnest(range({-r}, {r + 1}))::INT AS d) b WHERE a.d * a.d + b.d * b.d <= {r * r})) g
    JOIN {both} n ON n.image_id = g.image_id AND n.y = g.ny AND n.x = g.nx) GROUP BY ALL)"""


def _out(name: str) -> str:
    return f"SELECT image_id::VARCHAR AS image_id, y, x, round(v, 6) AS v FROM {name}"


def _each_pixel(spark, d, f):
    return each_image(_images(spark, d), PIXELS, lambda i, a: _pixel_rows(i, np.round(f(a.astype(float)), 6)))


@query(f"WITH {RASTER_SQL}, {SIZED}, {_blurred('blurred', 'sized', 1.5)} {_out('blurred')}")
def gaussian_blur(spark, d):
    """A normal blur of 1.5 pixels."""
    return _each_pixel(spark, d, lambda g: kernels.gaussian(g, 1.5))


@query(f"WITH {RASTER_SQL}, {SIZED}, {_joint('filtered', 'sized', 'sized', 4, 75, 75)} {_out('filtered')}")
def bilateral_filter(spark, d):
    """The bilateral filter that most styles begin with."""
    return _each_pixel(spark, d, kernels.bilateral)


@query(f"WITH {RASTER_SQL}, {SIZED}, {_blurred('now0', 'sized', 6.0)}, " + ", ".join(_joint(f"now{k + 1}", "sized", f"now{k}", 9, 35, 6) for k in range(4)) + " " + _out("now4"))
def rolling_guidance(spark, d):
    """All four rounds after the first blur."""
    return _each_pixel(spark, d, kernels.rolling_guidance)


@query(f"""WITH RECURSIVE {RASTER_SQL}, {SIZED}, shift AS (SELECT image_id, y, x, h, w, v::DOUBLE AS v, 0 AS step, false AS still FROM sized
  UNION ALL SELECT image_id, y, x, h, w, v, step, max(moved) OVER (PARTITION BY image_id) < 0.5 FROM (
    SELECT a.image_id, a.y, a.x, a.h, a.w, avg(b.v) AS v, any_value(a.step) + 1 AS step, abs(avg(b.v) - any_value(a.v)) AS moved
    FROM shift a, (SELECT unnest(range(-2, 3))::INT AS dy) oy, (SELECT unnest(range(-2, 3))::INT AS dx) ox, shift b
    WHERE NOT a.still AND a.step < 5 AND b.image_id = a.image_id AND b.y = {_mirrored('a.y + dy', 'a.h')} AND b.x = {_mirrored('a.x + dx', 'a.w')} AND 3 * (b.v - a.v) * (b.v - a.v) <= 400 GROUP BY a.image_id, a.y, a.x, a.h, a.w))
  SELECT image_id::VARCHAR AS image_id, y, x, round(arg_max(v, step) + {NUDGE}, 6) AS v FROM shift GROUP BY 1, 2, 3""")
def mean_shift(spark, d):
    """Each pixel moves to the mean of the near colours about it, five times at most; three equal channels."""
    return _each_pixel(spark, d, lambda g: kernels.mean_shift(np.dstack([g, g, g]), 2, 20)[..., 0] + NUDGE)


_AT = lambda dy, dx: f"(SELECT v FROM raster n WHERE n.image_id = s.image_id AND n.y = {_mirrored(f's.y + ({dy})', 's.h')} AND n.x = {_mirrored(f's.x + ({dx})', 's.w')})"
_NINE = ", ".join(f"{_AT(dy, dx)} AS v{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))


@query(f"""WITH RECURSIVE {RASTER_SQL}, {SIZED}, nine AS (SELECT image_id, y, x, {_NINE} FROM sized s),
  slopes AS (SELECT image_id, y, x, v02 + 2 * v12 + v22 - v00 - 2 * v10 - v20 AS gx, v20 + 2 * v21 + v22 - v00 - 2 * v01 - v02 AS gy FROM nine),
  mag AS (SELECT image_id, y, x, sqrt((gx * gx + gy * gy)::DOUBLE) AS m, ((round(atan2(gy, gx) / (pi() / 4))::INT % 4) + 4) % 4 AS way FROM slopes),
  high AS (SELECT image_id, quantile_cont(m, 0.925) AS high FROM mag GROUP BY 1),
  peak AS (SELECT a.image_id, a.y, a.x, a.m FROM mag a JOIN (SELECT unnest([0, 1, 2, 3]) AS way, unnest([0, 1, 1, 1]) AS dy, unnest([1, 1, 0, -1]) AS dx) o USING (way)
    LEFT JOIN mag f ON f.image_id = a.image_id AND f.y = a.y + dy AND f.x = a.x + dx LEFT JOIN mag b ON b.image_id = a.image_id AND b.y = a.y - dy AND b.x = a.x - dx WHERE a.m > coalesce(f.m, -1) AND a.m >= coalesce(b.m, -1)),
  weak AS (SELECT image_id, y, x, m, high FROM peak JOIN high USING (image_id) WHERE m >= 0.4 * high),
  edge AS (SELECT image_id, y, x FROM weak WHERE m >= high UNION SELECT w.image_id, w.y, w.x FROM edge e JOIN weak w ON w.image_id = e.image_id AND w.y BETWEEN e.y - 1 AND e.y + 1 AND w.x BETWEEN e.x - 1 AND e.x + 1)
  SELECT image_id::VARCHAR AS image_id, y, x FROM edge""")
def canny_edges(spark, d):
    """Canny's edges; the upper threshold is a percentile of the gradient, the lower two fifths of it."""

    def f(i, a):
        high = float(np.percentile(np.hypot(*kernels.sobel(a)), 92.5))
        return ((i, y, x) for y, x in np.argwhere(kernels.canny(a, 0.4 * high, high)).tolist())

    return each_image(_images(spark, d), "image_id string, y int, x int", f)


@query(f"""WITH RECURSIVE {RASTER_SQL}, {thinned('thin', 'SELECT image_id, y, x FROM raster WHERE v < 80')}, {stairless('lean', 'SELECT image_id, y, x FROM thin WHERE idle = 2')}
  SELECT t.image_id::VARCHAR AS image_id, t.y, t.x, l.y IS NOT NULL AS stays FROM thin t LEFT JOIN (SELECT image_id, y, x FROM lean WHERE idle = 4) l ON l.image_id = t.image_id AND l.y = t.y AND l.x = t.x WHERE t.idle = 2""")
def skeleton_pixels(spark, d):
    """The skeleton's pixels, and which stay without its stairs."""

    def f(i, a):
        thin = kernels.thin(a < 80)
        lean = kernels.without_stairs(thin)
        return ((i, y, x, bool(lean[y, x])) for y, x in np.argwhere(thin).tolist())

    return each_image(_images(spark, d), "image_id string, y int, x int, stays boolean", f)


@query(f"""WITH RECURSIVE {POINTS_SQL}, p AS (SELECT path_id, i, x, y, count(*) OVER (PARTITION BY path_id) AS n, closed FROM points),
  q AS (SELECT path_id, i, x, y FROM p UNION ALL SELECT path_id, n::INT, x, y FROM p WHERE closed AND i = 0),
  far AS (SELECT p.path_id, arg_min(p.i, (-(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), p.i)) AS i FROM p JOIN p o ON o.path_id = p.path_id AND o.i = 0 WHERE p.closed AND p.n > 2 GROUP BY 1),
  span AS (SELECT path_id, 0 AS a, i AS b FROM far UNION ALL SELECT path_id, far.i, n::INT FROM far JOIN (SELECT DISTINCT path_id, n FROM p) USING (path_id)
    UNION ALL SELECT DISTINCT path_id, 0, n::INT - 1 FROM p WHERE NOT closed AND n > 2
    UNION ALL SELECT path_id, unnest([a, k]), unnest([k, b]) FROM (
      SELECT path_id, a, b, arg_min(i, (-off, i)) AS k, max(off) AS off FROM (
        SELECT s.path_id, s.a, s.b, m.i, sqrt(pow(m.x - u.x - t * (v.x - u.x), 2) + pow(m.y - u.y - t * (v.y - u.y), 2)) AS off
        FROM span s JOIN q u ON u.path_id = s.path_id AND u.i = s.a JOIN q v ON v.path_id = s.path_id AND v.i = s.b JOIN q m ON m.path_id = s.path_id AND m.i > s.a AND m.i < s.b,
          LATERAL (SELECT CASE WHEN pow(v.x - u.x, 2) + pow(v.y - u.y, 2) = 0 THEN 0 ELSE greatest(0, least(1, ((m.x - u.x) * (v.x - u.x) + (m.y - u.y) * (v.y - u.y)) / (pow(v.x - u.x, 2) + pow(v.y - u.y, 2)))) END AS t)) GROUP BY 1, 2, 3) WHERE off > 0.15),
  kept AS (SELECT path_id, a AS i FROM span UNION SELECT path_id, b FROM span UNION SELECT path_id, i FROM p WHERE n <= 2)
  SELECT image_id, path_id, i FROM points JOIN kept USING (path_id, i)""")
def simplified_points(spark, d):
    """The points of paths that Douglas and Peucker's method keeps at 0.15 of the side; a path is gathered by a task."""
    p = points(spark, d)
    paths = p.groupBy("image_id", "path_id", "closed").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = np.array([(q["x"], q["y"], q["i"]) for q in r["p"]])
                kept = kernels.kept_points(at[:, :2], 0.15, r["closed"])
                out += [(r["image_id"], r["path_id"], int(i)) for i in at[kept, 2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["image_id", "path_id", "i"])

    return paths.mapInArrow(run, "image_id long, path_id long, i int")

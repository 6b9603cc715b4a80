"""Media columns: copies of images by local descriptors.

Corners are found at several scales; each gets an orientation from the centroid of its surroundings
and 256 binary brightness tests in the frame turned by it. Windows of its bits are chunks, and each
place of a window is a hash table of its own: two descriptors meet if some chunk of theirs is equal, which joins
on (chunk, value) and then checks by the whole Hamming distance. Every match votes for a turn, a
scale and a shift; a copy is a pair of images of which enough matches agree. Images of equal corners are one set, whose
first image is searched for all; images that are copies of each other form classes, which are listed beside, and whose
corners vote together.

The tables here hold no media files, so op7 renders each embedding to a raster, a third of the
queries turned, all of them cropped, brightened and with a patch drawn over them.

Defined cases: a null or empty raster, or one smaller than the least size, has no corners and matches nothing; repeated
rows match each other as copies; a very large raster is one row, held whole by one task; null entries of an embedding count as 0; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, table
from .components import components

#: Sides of the pyramid's levels against the image, corners kept for an image, and the patch's radius.
SCALES = (1.0, 0.7, 0.5)
CORNERS = 32
#: Corners of an indexed image that go into the tables: all, as an alteration may hide any of them.
INDEXED = CORNERS
RADIUS = 7
TURNS = 32
BITS = 256
#: Tables are of windows of so many bits that begin every CHUNK_STEP, the last ones round the end. Neighbouring tests are alike, so narrow
#: windows are often equal by chance: of 32 bits 4.9 % of all entries meet one of 60 queries, of 40 bits 1.8 %, of 48 bits 0.8 %.
CHUNK_BITS, CHUNK_STEP = 48, 24
STARTS = range(0, BITS, CHUNK_STEP)
CHUNKS = len(STARTS)
#: Largest Hamming distance of a match, and matches that must agree.
MOST_APART = 24
LEAST_AGREEING = 3
SHIFT_BIN = 8.0
#: Tables that classes are formed by at once; each part's shuffle files go before the next.
TABLES_AT_ONCE = 2
#: A chunk that more than this share of the rows has, and so many rows, is dealt to several tasks.
HOT_SHARE, HOT_LEAST = 0.001, 4096
#: Bits of the filter that keeps chunks no query has out of the shuffle.
FILTER_BITS = 1 << 24


def _pattern() -> np.ndarray:
    """(TURNS, BITS, 2 points, y and x): pairs of places, drawn about the middle, turned."""
    rng = np.random.default_rng(20)
    p = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS, RADIUS)
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    y = p[None, :, :, 0] * np.cos(a)[:, None, None] + p[None, :, :, 1] * np.sin(a)[:, None, None]
    x = p[None, :, :, 1] * np.cos(a)[:, None, None] - p[None, :, :, 0] * np.sin(a)[:, None, None]
    return np.rint(np.stack([y, x], -1)).astype(np.int64)


PATTERN = _pattern()
EDGE = int(np.abs(PATTERN).max()) + 1
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_YY**2 + _XX**2) <= RADIUS**2


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, edges repeated; the last two axes are the image's."""
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis)
        n = a.shape[axis]
        a = (np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, range(n), axis)) / (2 * r + 1)
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    if scale == 1:
        return a
    out = a
    for axis in (-2, -1):
        n = out.shape[axis]
        m = max(1, round(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(0, n - 2))
        hi = np.minimum(lo + 1, n - 1)
        w = (at - lo).reshape((-1, 1) if axis == -2 else (1, -1))
        out = np.take(out, lo, axis) * (1 - w) + np.take(out, hi, axis) * w
    return out


def describe(images: np.ndarray, most: int = CORNERS) -> tuple[np.ndarray, ...]:
    """Of rasters of one size (n, height, width): image, y, x, scale, angle, descriptor (4 words) of each corner."""
    none = (np.empty(0, int), *(np.empty(0) for _ in range(4)), np.empty((0, BITS // 64), np.int64))
    found = []
    for scale in SCALES:
        a = _box(_resized(images.astype(float), scale), 1)
        h, w = a.shape[1:]
        if min(h, w) <= 2 * EDGE + 2:
            continue
        gy, gx = np.gradient(a, axis=1), np.gradient(a, axis=2)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = np.ones_like(r, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= r > np.roll(r, (dy, dx), (1, 2)) if (dy, dx) > (0, 0) else r >= np.roll(r, (dy, dx), (1, 2))
        inside = np.zeros_like(peak)
        inside[:, EDGE : h - EDGE, EDGE : w - EDGE] = True
        i, y, x = np.nonzero(peak & inside & (r > 1e-6))
        found.append((i, y, x, np.full(len(i), scale), r[i, y, x], a))
    if not found:
        return none
    level = np.concatenate([np.full(len(f[0]), k) for k, f in enumerate(found)])
    i, y, x, s, r = (np.concatenate([f[k] for f in found]) for k in range(5))
    order = np.lexsort((x, y, s, -r, i))
    first = np.r_[True, i[order][1:] != i[order][:-1]] if len(order) else np.empty(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    keep = order[rank < most]
    level, i, y, x, s = level[keep], i[keep], y[keep], x[keep], s[keep]
    angle, words = np.zeros(len(i)), np.zeros((len(i), BITS // 64), np.int64)
    for k, f in enumerate(found):
        at = np.flatnonzero(level == k)
        for part in np.array_split(at, max(1, len(at) // 4000)):
            if not len(part):
                continue
            a = f[5]
            around = a[i[part, None, None], np.clip(y[part, None, None] + _YY, 0, a.shape[1] - 1), np.clip(x[part, None, None] + _XX, 0, a.shape[2] - 1)] * DISC
            theta = np.arctan2((around * _YY).sum((1, 2)), (around * _XX).sum((1, 2)))
            angle[part] = theta
            turn = np.rint(theta * TURNS / (2 * np.pi)).astype(int) % TURNS
            p = PATTERN[turn]
            v = a[i[part, None, None], y[part, None, None] + p[..., 0], x[part, None, None] + p[..., 1]]
            bits = v[:, :, 0] < v[:, :, 1]
            words[part] = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return i, (y + 0.5) / s - 0.5, (x + 0.5) / s - 0.5, s, angle, words


CORNER = "image_id long, y double, x double, scale double, angle double, d0 long, d1 long, d2 long, d3 long"
CORNER_COLUMNS = [c.split()[0] for c in CORNER.split(", ")]


def corners(images: DataFrame, most: int = CORNERS) -> DataFrame:
    """The strongest corners of (image_id, height, width, data), data one byte for each pixel, row by row."""

    def run(batches):
        for batch in batches:
            ids, h, w = (batch.column(k).to_pylist() for k in ("image_id", "height", "width"))
            by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            for k, data in enumerate(batch.column("data")):
                raw = data.as_buffer()
                if raw is not None and h[k] and w[k] and raw.size == h[k] * w[k]:
                    by_size.setdefault((h[k], w[k]), []).append((ids[k], np.frombuffer(raw, np.uint8).reshape(h[k], w[k])))
            for some in by_size.values():
                for at in range(0, len(some), 128):
                    part = some[at : at + 128]
                    i, y, x, s, angle, words = describe(np.stack([a for _, a in part]), most)
                    own = pa.array([part[k][0] for k in i.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([own, *map(pa.array, (y, x, s, angle)), *(pa.array(words[:, k]) for k in range(4))], names=CORNER_COLUMNS)

    return images.select("image_id", "height", "width", "data").mapInArrow(run, CORNER)


def _chunks(found: DataFrame, which: Iterable[int] = range(CHUNKS)) -> DataFrame:
    """A row for each chunk of each descriptor: which chunk, and its value."""
    mask = F.lit((1 << CHUNK_BITS) - 1)

    def value(start: int):
        word, off = divmod(start, 64)
        here = F.shiftrightunsigned(f"d{word}", off)
        return (here if off + CHUNK_BITS <= 64 else here.bitwiseOR(F.shiftleft(f"d{(word + 1) % 4}", 64 - off))).bitwiseAND(mask)

    parts = [F.struct(F.lit(c).alias("chunk"), value(STARTS[c]).alias("value")) for c in which]
    return found.withColumn("part", F.explode(F.array(*parts))).select("*", "part.chunk", "part.value").drop("part")


def _values(words: np.ndarray) -> np.ndarray:
    """The same of descriptors (n, 4): values (n, CHUNKS)."""
    w = words.view(np.uint64)
    out = np.empty((len(w), CHUNKS), np.uint64)
    for c, start in enumerate(STARTS):
        word, off = divmod(start, 64)
        v = w[:, word] >> np.uint64(off)
        if off + CHUNK_BITS > 64:
            v = v | (w[:, (word + 1) % 4] << np.uint64(64 - off))
        out[:, c] = v & np.uint64((1 << CHUNK_BITS) - 1)
    return out


def _places(values: np.ndarray) -> np.ndarray:
    """Places in the filter of chunk values (n, CHUNKS)."""
    return (mix64(values * np.uint64(CHUNKS) + np.arange(CHUNKS, dtype=np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _asked_bits(queries: DataFrame) -> np.ndarray:
    """The filter of all chunks of the queries: of one size at any scale, gathered as 64-bit words that are combined
    before they reach the driver."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = np.unique(_places(_values(_words(batch))))
                yield pa.RecordBatch.from_arrays([pa.array(p // 64), pa.array(np.left_shift(np.int64(1), p % 64))], names=["w", "bit"])

    got = queries.select("d0", "d1", "d2", "d3").mapInArrow(run, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"d{k}").to_numpy() for k in range(4)], 1)


def _chunks_asked(found: DataFrame, bits: np.ndarray) -> DataFrame:
    """_chunks() without those that surely no query has, so that few rows are shuffled."""
    shared = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(_words(batch))
            p = _places(values)
            row, chunk = np.nonzero(shared.value[p // 64] >> (p % 64) & 1)
            value = values[row, chunk].astype(np.int64)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(chunk.astype(np.int32)), pa.array(value)], names=[*batch.schema.names, "chunk", "value"])

    return found.mapInArrow(run, CORNER + ", chunk int, value long")


GEOMETRY = ("image_id", "y", "x", "scale", "angle")


def _agreeing(matches: DataFrame, least: int, holder: Column | str = "holder") -> DataFrame:
    """query_id, image_id, holder, n_agreeing, turn, scale of the pairs of which at least ``least`` corners agree on one similarity,
    from corner matches with the query's columns prefixed by q_. A pair of corners that meets in several tables
    counts once. The holder is the smallest image in which corners of the best agreement lie."""
    turn = F.col("angle") - F.col("q_angle")
    zoom = F.col("q_scale") / F.col("scale")
    dy = F.col("y") - zoom * (F.col("q_y") * F.cos(turn) + F.col("q_x") * F.sin(turn))
    dx = F.col("x") - zoom * (F.col("q_x") * F.cos(turn) - F.col("q_y") * F.sin(turn))
    places = F.round(F.pmod(turn, F.lit(2 * np.pi)) * (12 / (2 * np.pi))) % 12
    size = F.round(F.log(zoom) * 4)
    # votes fall into two overlapping grids of shifts along each axis, so a bin's edge parts no agreeing matches
    shifts = F.array(*(F.struct(F.floor(dy / SHIFT_BIN + a / 2).alias("ty"), F.floor(dx / SHIFT_BIN + b / 2).alias("tx"), F.lit(2 * a + b).alias("grid")) for a in (0, 1) for b in (0, 1)))
    votes = matches.select("q_image_id", "image_id", holder, places.alias("turn"), size.alias("size"), F.struct("q_y", "q_x", "q_scale").alias("corner"), F.explode(shifts).alias("s"))
    agreed = votes.groupBy("q_image_id", "image_id", "turn", "size", "s").agg(F.countDistinct("corner").alias("n"), F.min("holder").alias("holder"))
    best = agreed.where(F.col("n") >= least).groupBy("q_image_id", "image_id").agg(F.max(F.struct("n", "turn", "size", -F.col("holder"))).alias("b"))
    return best.select(F.col("q_image_id").alias("query_id"), "image_id", (-F.col("b.col4")).alias("holder"), F.col("b.n").alias("n_agreeing"), (F.col("b.turn") * (360 / 12)).alias("turn"), F.round(F.exp(F.col("b.size") / 4), 3).alias("scale"))


def _apart(a: str, b: str):
    one = lambda k: F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")))
    return one(0) + one(1) + one(2) + one(3)


def _spread(few: DataFrame, many: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The join of two tables on ``keys`` where a key may have very many rows of ``many``, which is read twice: pass a
    table. Such a key's rows are dealt by ``by`` to several tasks, each with the key's rows of ``few``. A key counts as hot beyond
    a share of all rows, so hot keys are at most 1 / HOT_SHARE and may be broadcast."""
    size = max(HOT_LEAST, int(many.count() * HOT_SHARE))
    hot = F.broadcast(many.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > size).select(*keys, F.ceil(F.col("rows") / size).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    few = few.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    many = many.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*by), salts)).drop("salts")
    return few.join(many, [*keys, "salt"]).drop("salt")


def _one_for_all(found: DataFrame, members: DataFrame) -> DataFrame:
    """Table entries (image_id, chunk, value, holder, corner) of the corners of images in classes, named by class, holder being the
    image they are of. Of entries of one class with the same value, place and angle one stands for all: they would cast
    the same vote. So a class of very many near copies has about as many entries as one of few."""
    entries = _chunks(found.join(members.select("image_id", "class_id"), "image_id"))
    cells = [F.round(F.col("y")).alias("cy"), F.round(F.col("x")).alias("cx"), F.round(F.col("angle") * (12 / (2 * np.pi))).alias("ca")]
    one = F.min_by(F.struct(*CORNER_COLUMNS), F.struct("image_id", "y", "x", "angle")).alias("e")
    shared = entries.groupBy("class_id", "chunk", "value", "scale", *cells).agg(one)
    return shared.select(F.col("class_id").alias("image_id"), F.col("e.image_id").alias("holder"), "chunk", "value", *(f"e.{c}" for c in CORNER_COLUMNS if c != "image_id"))


def copies(queries: DataFrame, found: DataFrame, members: DataFrame | None = None, most_apart: int = MOST_APART, least: int = LEAST_AGREEING) -> DataFrame:
    """The pairs of _agreeing() of queries and images; both sides are corners(). With ``members`` (image_id, class_id) images
    of one class are searched as one: image_id is the class then, whose images' corners vote together."""
    q = _chunks(queries.select(*(F.col(c).alias(f"q_{c}") for c in GEOMETRY), "d0", "d1", "d2", "d3"))
    q = q.select("chunk", "value", *(f"q_{c}" for c in GEOMETRY), *(F.col(f"d{k}").alias(f"e{k}") for k in range(4)))
    alone = found if members is None else found.join(members.select("image_id"), "image_id", "left_anti").select(*CORNER_COLUMNS)
    entries = _chunks_asked(alone, _asked_bits(queries)).withColumn("holder", F.col("image_id"))
    if members is not None:
        entries = entries.unionByName(_one_for_all(found, members))
    return _agreeing(_spread(q, cut(entries, "entries"), ["chunk", "value"], ["holder"]).where(_apart("d", "e") <= most_apart), least)


def classes(found: DataFrame, most_apart: int = MOST_APART, least: int = LEAST_AGREEING) -> DataFrame:
    """(image_id, class_id) of images that are copies of others, the class being its smallest image_id. Each bucket of a
    table has its smallest image as leader, and images are compared with leaders only, so the work is in proportion to the
    corners, not to the square of a group. All links to leaders count. The tables are taken a few at a time."""
    leader = F.min_by(F.struct(*GEOMETRY, "d0", "d1", "d2", "d3"), F.struct("image_id", "y", "x", "scale")).alias("l")
    parts = []
    for at in range(0, CHUNKS, TABLES_AT_ONCE):
        rows = _chunks(found, range(at, min(CHUNKS, at + TABLES_AT_ONCE)))
        leaders = rows.groupBy("chunk", "value").agg(leader, F.max("image_id").alias("last")).where(F.col("last") > F.col("l.image_id")).select("chunk", "value", *(F.col(f"l.{c}").alias(f"q_{c}") for c in GEOMETRY), *(F.col(f"l.d{k}").alias(f"e{k}") for k in range(4)))
        met = rows.join(leaders, ["chunk", "value"]).where((F.col("image_id") > F.col("q_image_id")) & (_apart("d", "e") <= most_apart))
        parts.append(cut(met.select(*GEOMETRY, *(f"q_{c}" for c in GEOMETRY)), "met"))
    links = _agreeing(reduce(DataFrame.unionByName, parts), least, F.col("image_id").alias("holder"))
    return components(links.select(F.col("image_id").alias("a"), F.col("query_id").alias("b"))).select(F.col("node").alias("image_id"), F.col("root").alias("class_id"))


def sets(found: DataFrame) -> DataFrame:
    """(image_id, set_id) of images whose corners all equal another's, up to collisions of 64-bit hashes; the set is its
    smallest image_id. Whatever is a copy of one of a set is a copy of all in it, in the same way."""
    h = F.xxhash64(*GEOMETRY[1:], "d0", "d1", "d2", "d3")
    marks = found.where("image_id is not null").groupBy("image_id").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x"))
    marks = cut(marks, "marks")
    shared = marks.groupBy("n", "s", "x").agg(F.min("image_id").alias("set_id"), F.max("image_id").alias("last")).where("last > set_id").drop("last")
    return marks.join(shared, ["n", "s", "x"]).select("image_id", "set_id")


SIDE = 64


def render(e: np.ndarray) -> np.ndarray:
    """Rasters of embeddings (n, d): squares of three sizes, each of the value of one dimension."""
    e = np.nan_to_num(e.astype(float))
    d = e.shape[1]
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    v = sum(weight * e[:, ((y // side) * step + (x // side) * 7 + step) % d] for side, step, weight in ((8, 8, 1.0), (4, 13, 0.8), (2, 29, 0.5)))
    low, high = v.min((1, 2), keepdims=True), v.max((1, 2), keepdims=True)
    return ((v - low) / np.maximum(high - low, 1e-9) * 220 + 10).astype(np.uint8)


def altered(a: np.ndarray, number: int) -> np.ndarray:
    """A copy of a raster: cropped, dimmed, a patch over it, and one of three turned by a right angle."""
    c = a[6:, 4:].copy()
    c = (c * 0.85 + 12).astype(np.uint8)
    c[-14:, -14:] = 128
    return np.ascontiguousarray(np.rot90(c)) if number // 100 % 3 == 0 else c


IMAGE = "image_id long, height int, width int, data binary"


def rendered(vectors: DataFrame, alter: bool = False) -> DataFrame:
    """IMAGE rows of (vec_id, embedding); with ``alter`` the copies that serve as queries."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            values = [[0.0 if x is None else x for x in v or []] for v in batch.column("embedding").to_pylist()]
            out = []
            for i, v in zip(ids, values, strict=True):
                a = render(np.array([v], np.float32))[0] if v else np.empty((0, 0), np.uint8)
                out.append(altered(a, i or 0) if alter and v else a)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a.shape[0] for a in out], pa.int32()), pa.array([a.shape[1] for a in out], pa.int32()), pa.array([a.tobytes() for a in out], pa.binary())], names=["image_id", "height", "width", "data"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, IMAGE)


def grouped(same: DataFrame, near: DataFrame) -> DataFrame:
    """(image_id, set_id, class_id) of the images in sets or classes of more than one, from sets() and the classes() of the
    sets' first images."""
    joined = same.join(near.select(F.col("image_id").alias("set_id"), "class_id"), "set_id", "left")
    firsts = near.join(same.select("image_id"), "image_id", "left_anti")
    return joined.select("image_id", "set_id", F.coalesce("class_id", "set_id").alias("class_id")).unionByName(firsts.select("image_id", F.col("image_id").alias("set_id"), "class_id"))


def listed(queries: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """What a search by classes found, as rows of two kinds. ``query``: a row for each query (vec_id) and each class that holds a copy of
    it, image_id being one that does; a query without copies has one row of nulls. ``member``: the rows of members (image_id,
    class_id, further columns), the images in classes of more than one; any other image is its own class. So rows grow
    with queries and images, not with the square of a class, and every copy is named by its class."""
    by_class = pairs.select("query_id", F.col("image_id").alias("class_id"), F.col("holder").alias("image_id"), "n_agreeing", "turn", "scale")
    found = queries.select(F.col("vec_id").alias("query_id")).join(by_class, "query_id", "left")
    out = found.select(F.lit("query").alias("kind"), "query_id", "class_id", "image_id", "n_agreeing", "turn", "scale")
    return out.unionByName(members.select(F.lit("member").alias("kind"), *members.columns), allowMissingColumns=True)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altered copies of every image whose id is divisible by 100, searched for among all images. Images of equal corners
    are one set and its first image stands for it; the corners of all other images are in the tables, those of a
    class together. Rows are those of listed(), members with the columns of grouped()."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    queries = vectors.where("vec_id % 100 = 0")
    asked = cut(corners(rendered(queries, alter=True)), "asked")
    every = cut(corners(rendered(vectors), INDEXED), "corners")
    same = cut(sets(every), "sets")
    distinct = every.join(same.where("image_id <> set_id").select("image_id"), "image_id", "left_anti")
    members = cut(grouped(same, classes(distinct)), "members")
    return listed(queries, cut(copies(asked, distinct, members), "pairs"), members)

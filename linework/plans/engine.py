"""Conversion of images to line art as a DataFrame operator: an image is one row and one unit of work.

Sizes are checked before pixels are read, errors are caught for each row, and what a style needs besides the image, such
as a network, is loaded once in a Python worker.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators import gate, kernels, styles

#: Mm thresholds of a detail level and the networks' resolution.
DETAIL = {"toddler": (300.0, 6.0, 1.0, 512), "child": (120.0, 3.0, 0.6, 768), "adult": (25.0, 1.5, 0.3, 1280)}
#: Where a caller's network may run; it is handed to the function that loads it.
DEVICES = ("cpu", "cuda", "auto")


@dataclass(frozen=True)
class Profile:
    page: gate.Page = field(default_factory=gate.Page)
    style: str = "lineart-raster"
    detail: str = "child"
    max_pixels: int = 40_000_000
    working_dimension: int = 1400
    seed: int | None = 0
    strict: bool = False
    device: str = "auto"
    debug_dir: str | None = None

    def __post_init__(self):
        if self.detail not in DETAIL:
            raise ValueError(f"unknown detail {self.detail!r}; known: {', '.join(DETAIL)}")
        if self.device not in DEVICES:
            raise ValueError(f"unknown device {self.device!r}; known: {', '.join(DEVICES)}")

    def with_overrides(self, **changes) -> Profile:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Profile:
        found = json.loads(text)
        if not isinstance(found, dict) or set(found) - set(cls.__dataclass_fields__):
            raise ValueError("a profile is an object of known fields")
        if "page" in found:
            page = found["page"]
            if set(page) != set(gate.Page.__dataclass_fields__):
                raise ValueError("a page needs every field")
            found["page"] = gate.Page(**page | {"size": tuple(page["size"]) if isinstance(page["size"], list) else page["size"]})
        return cls(**found)


def apply_detail(art: styles.Drawing, profile: Profile) -> styles.Drawing:
    """Paths long enough, then regions large enough, then simplified; all in mm on the page."""
    area, stroke, epsilon, _ = DETAIL[profile.detail]
    scale, _, _ = profile.page.fit(art.aspect)
    content = scale * scale / art.aspect if art.aspect >= 1 else scale * scale * art.aspect
    kinds, areas = art.kinds or [art.kind] * len(art.paths), art.areas or [None] * len(art.paths)
    kept = [(p, c, kind, a) for (p, c), kind, a in zip(art.paths, kinds, areas, strict=True) if kernels.path_length(p, c) >= stroke / scale and (a is None or content <= 0 or a >= area / content)]
    return replace(art, paths=[(kernels.simplify(p, epsilon / scale, c), c) for p, c, _, _ in kept], kinds=[x[2] for x in kept], areas=[x[3] for x in kept])


REPORT = "ink_coverage double, enclosed_regions int, leaking_regions int, min_region_area_mm2 double, region_area_mm2_p5 double, dangling_endpoints int, antialiased_fraction double"
PATHS = "array<struct<points: array<struct<x: float, y: float>>, closed: boolean, kind: string, source_area: double>>"
SCHEMA = f"image_id string, style string, aspect_ratio double, paths {PATHS}, raster binary, raster_height int, raster_width int, {REPORT}, passed boolean, timings map<string, double>, error_class string, error_msg string"


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR of three channels; gray is repeated, a fourth channel goes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.ascontiguousarray(np.repeat(a, 3, 2) if channels == 1 else a[..., :3])


def seed_of(seed: int, image_id: str) -> int:
    """An image's own seed, which depends neither on its task nor on the images before it; without an id the seed itself."""
    return zlib.crc32(image_id.encode(), seed) if image_id else seed


def convert_array(image: np.ndarray, profile: Profile, extras: dict | None = None, image_id: str = ""):
    """(art, report, timings) of one BGR image."""
    timings, at = {}, time.perf_counter()

    def done(stage: str) -> None:
        nonlocal at
        timings[stage], at = time.perf_counter() - at, time.perf_counter()

    if profile.seed is not None:
        np.random.seed(seed_of(profile.seed, image_id))
    small = kernels.downscaled(image, profile.working_dimension)
    done("resize")
    art = styles.get(profile.style)(small, **(extras or {}))
    done("engine")
    if isinstance(art, styles.Drawing):
        art = apply_detail(art, profile)
        done("detail_filter")
    report = gate.validate(art, profile.page)
    done("validate")
    return art, report, timings


def convert(images: DataFrame, profile: Profile | None = None, load: Callable[[], dict] | None = None) -> DataFrame:
    """A row of SCHEMA for each image. ``load`` makes what the style gets besides the image (model, masks); it runs once in
    a task. Too large images never reach Python; one without a size, channels or data is unsupported."""
    profile = profile or Profile()
    styles.get(profile.style)
    pixels = F.col("height").cast("long") * F.col("width")
    whole = F.coalesce((pixels > 0) & F.col("data").isNotNull() & F.col("n_channels").isNotNull(), F.lit(False))
    no = F.when(F.col("error_class").isNotNull(), F.col("error_class")).when(~whole, "unsupported_image").when(pixels > profile.max_pixels, "image_too_large")
    checked = images.withColumn("_no", no)

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extras = load() if load else None
        for batch in batches:
            rows = [_row(r, profile, extras) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    made = checked.where("_no is null").select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, SCHEMA)
    refused = checked.where("_no is not null").select("image_id", F.lit(profile.style).alias("style"), F.col("_no").alias("error_class"))
    return made.unionByName(refused, allowMissingColumns=True)


def _row(r: dict, profile: Profile, extras: dict | None) -> dict:
    out = {"image_id": r["image_id"], "style": profile.style}
    try:
        art, report, timings = convert_array(decode(r["data"], r["height"], r["width"], r["n_channels"]), profile, extras, r["image_id"] or "")
    except Exception as e:  # one bad image must not end the batch
        return out | {"error_class": type(e).__name__, "error_msg": str(e)[:500]}
    out |= {"aspect_ratio": art.aspect, "timings": list(timings.items()), "passed": report.passed}
    out |= {x.split()[0]: getattr(report, x.split()[0]) for x in REPORT.split(", ")}
    if isinstance(art, styles.Raster):
        return out | {"raster": art.image.tobytes(), "raster_height": art.image.shape[0], "raster_width": art.image.shape[1]}
    kinds, areas = art.kinds or [art.kind] * len(art.paths), art.areas or [None] * len(art.paths)
    return out | {"paths": [{"points": [{"x": x, "y": y} for x, y in p.tolist()], "closed": bool(c), "kind": kind, "source_area": a} for (p, c), kind, a in zip(art.paths, kinds, areas, strict=True)]}


def paths(converted: DataFrame) -> DataFrame:
    """The paths relation: a row for each path."""
    return converted.select("image_id", F.posexplode("paths").alias("path_id", "p")).select("image_id", "path_id", "p.points", "p.closed", "p.kind", "p.source_area")


def points(converted: DataFrame) -> DataFrame:
    """The points relation, as the vector operators read it."""
    return paths(converted).select("image_id", "path_id", F.posexplode("points").alias("i", "q"), "closed", "kind").select("image_id", "path_id", "i", "q.x", "q.y", "closed", "kind")


def status(converted: DataFrame, strict: bool = False) -> DataFrame:
    """Batch status: (input_path, error, passed_strict)."""
    return converted.select(F.col("image_id").alias("input_path"), F.col("error_class").alias("error"), (F.col("passed") if strict else F.lit(None).cast("boolean")).alias("passed_strict"))


def art_of(row) -> styles.Drawing | styles.Raster:
    """The art of a converted row."""
    if row["raster"] is not None:
        return styles.Raster(np.frombuffer(row["raster"], np.uint8).reshape(row["raster_height"], row["raster_width"]), row["aspect_ratio"])
    return styles.Drawing([(np.array([(p["x"], p["y"]) for p in x["points"]], np.float32).reshape(-1, 2), x["closed"]) for x in row["paths"]], row["aspect_ratio"])


def rendered(converted: DataFrame, page: gate.Page, form: str) -> DataFrame:
    """(image_id, content) of the images without errors as svg, pdf or png."""
    if form not in ("svg", "pdf", "png"):
        raise ValueError(f"unknown format {form!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                art = art_of(r)
                out.append(gate.to_svg(art, page).encode() if form == "svg" else gate.to_pdf(art, page) if form == "pdf" else kernels.png(gate.to_png(art, page)))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    return converted.where("error_class is null").select("image_id", "aspect_ratio", "paths", "raster", "raster_height", "raster_width").mapInArrow(run, "image_id string, content binary")


def save(files: DataFrame, folder: str, form: str) -> int:
    """Write each row's content to a file of its own, from the tasks that hold the rows, into a folder that all of them reach. Equal
    stems are told apart by a number, in the order of image_id. Returns how many."""
    stem = F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"(?<=.)\.[^.]*$", "")
    numbered = files.select(stem.alias("stem"), "image_id", "content").withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("image_id")))
    named = numbered.select(F.concat("stem", F.when(F.col("k") > 1, F.concat(F.lit("-"), "k")).otherwise("")).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                half = os.path.join(folder, f".{name}.{form}.{os.getpid()}")
                with open(half, "wb") as f:
                    f.write(content.as_buffer() or b"")
                os.replace(half, os.path.join(folder, f"{name}.{form}"))  # a task that runs again leaves whole files
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return named.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

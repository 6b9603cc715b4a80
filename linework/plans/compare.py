"""Images by styles: comparison, ablation and segment evaluation tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators import gate, kernels, styles
from .engine import Profile, convert_array, decode

METRICS = "ink_coverage double, component_count long, median_stroke_length double, noise_fraction double"
REFERENCE = "ref_precision double, ref_recall double, ref_f1 double, ref_f1_normalized double, ref_ink_admissible boolean"
SCHEMA = f"image_id string, style string, {METRICS}, {REFERENCE}, error_class string"


def line_art(image: np.ndarray, style: str, extras: dict | None, profile: Profile, long_side: int | None = None) -> np.ndarray:
    """The style's lines as a raster of the image's size (or that longer side), without the page."""
    small = kernels.downscaled(image, profile.working_dimension)
    art = styles.get(style)(small, **(extras or {}))
    if isinstance(art, styles.Raster):
        return art.image
    return kernels.rasterize(art.paths, art.aspect, long_side or max(small.shape[:2]), max(1, round(max(small.shape[:2]) / 700)))


def _metrics(lines: np.ndarray, reference: np.ndarray | None) -> dict:
    out = gate.line_metrics(lines)
    if reference is not None:
        ref = np.clip(np.rint(kernels.resize(reference.astype(float), *lines.shape)), 0, 255).astype(np.uint8)
        out |= {f"ref_{k}": v for k, v in gate.compare_boundaries(lines, ref).items()}
    return out


def compare(images: DataFrame, names: list[str], profile: Profile | None = None, load: Callable[[], dict] | None = None, references: DataFrame | None = None) -> DataFrame:
    """A row for each image and style. A style that fails, or lacks its network, has its error and no metrics, and an
    image without a reference (image_id, height, width, data: gray) blank ref columns."""
    profile = profile or Profile()
    joined = images.where("error_class is null").select("image_id", "height", "width", "n_channels", "data")
    refs = ["ref_height", "ref_width", "ref_data"]
    if references is None:
        joined = joined.select("*", F.lit(None).cast("int").alias(refs[0]), F.lit(None).cast("int").alias(refs[1]), F.lit(None).cast("binary").alias(refs[2]))
    else:
        joined = joined.join(references.select("image_id", *(F.col(c.removeprefix("ref_")).alias(c) for c in refs)), "image_id", "left")
    grid = joined.withColumn("style", F.explode(F.array(*map(F.lit, names))))
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        extras = load() if load else {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {"image_id": r["image_id"], "style": r["style"]}
                try:
                    reference = None if r["ref_data"] is None else np.frombuffer(r["ref_data"], np.uint8).reshape(r["ref_height"], r["ref_width"])
                    row |= _metrics(line_art(decode(r["data"], r["height"], r["width"], r["n_channels"]), r["style"], extras.get(r["style"]), profile), reference)
                except Exception as e:  # one style must not end the comparison
                    row["error_class"] = type(e).__name__
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return grid.mapInArrow(run, SCHEMA)


def ablation(images: DataFrame, variants: dict[str, tuple[str, dict]], profile: Profile | None = None) -> DataFrame:
    """(image_id, variant, seconds, metrics) of variants of styles at the images' own size: a variant is a style and what it gets."""
    profile = profile or Profile(working_dimension=1 << 30)
    out = f"image_id string, variant string, seconds double, {METRICS}, error_class string"
    schema = to_arrow_schema(_parse_datatype_string(out))
    grid = images.where("error_class is null").select("image_id", "height", "width", "n_channels", "data").withColumn("variant", F.explode(F.array(*map(F.lit, variants))))

    def run(batches):
        import time

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row, began = {"image_id": r["image_id"], "variant": r["variant"]}, time.perf_counter()
                style, extras = variants[r["variant"]]
                try:
                    row |= _metrics(line_art(decode(r["data"], r["height"], r["width"], r["n_channels"]), style, extras, profile), None)
                except Exception as e:
                    row["error_class"] = type(e).__name__
                rows.append(row | {"seconds": time.perf_counter() - began})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return grid.mapInArrow(run, out)


def stages(images: DataFrame, profile: Profile, load: Callable[[], dict] | None = None) -> DataFrame:
    """(image_id, seq, stage, png): what a style saw on its way."""

    def run(batches):
        extras = load() if load else None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    art, _, _ = convert_array(decode(r["data"], r["height"], r["width"], r["n_channels"]), profile, extras, r["image_id"] or "")
                except Exception:  # its error is in the row that convert() makes
                    continue
                for seq, (name, a) in enumerate(art.stages):
                    a = np.where(a, 0, 255) if a.dtype == bool else a
                    gray = kernels.to_gray(a) if a.ndim == 3 else np.clip(a, 0, 255)
                    rows.append((r["image_id"], seq, name, kernels.png(gray.astype(np.uint8))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["image_id", "seq", "stage", "png"])

    return images.where("error_class is null").select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, "image_id string, seq int, stage string, png binary")


def save_stages(images: DataFrame, profile: Profile, load: Callable[[], dict] | None = None) -> int:
    """Write the stages of each image as NN_stage.png into a folder of its own below profile.debug_dir, from the tasks that made them.
    Returns how many."""
    folder = profile.debug_dir

    def run(batches):
        for batch in batches:
            for image_id, seq, name, png in zip(*(batch.column(c).to_pylist() for c in ("image_id", "seq", "stage", "png")), strict=True):
                own = os.path.join(folder, os.path.splitext(os.path.basename(image_id))[0])
                os.makedirs(own, exist_ok=True)
                with open(os.path.join(own, f"{seq:02d}_{name}.png"), "wb") as f:
                    f.write(png)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return stages(images, profile, load).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0


def evaluate_segments(image: np.ndarray, masks: Callable, least: int, rounds: int = 20) -> dict:
    """Segments of a mask function, small ones merged into the nearest colour, their outlines and whether they would do."""
    h, w = image.shape[:2]
    labels = styles.smallest_mask_labels((h, w), list(masks(image)))
    lab = kernels.to_lab(image)
    for _ in range(rounds):
        mean, area = styles.label_means(lab, labels), np.bincount(labels.ravel())
        small = {int(x) for x in np.flatnonzero((area > 0) & (area < least))}
        near: dict[int, set[int]] = {}
        for a, b in ((labels[:, 1:], labels[:, :-1]), (labels[1:], labels[:-1])):
            for x, y in np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0).tolist() if (a != b).any() else []:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        to = np.arange(len(area))
        for x in small:
            if near.get(x):
                to[x] = min(near[x], key=lambda y: (float(np.linalg.norm(mean[x] - mean[y])), y))
        if (to == np.arange(len(area))).all():
            break
        mutual = to[to] == np.arange(len(area))
        to = np.where(mutual, np.minimum(to, np.arange(len(area))), to)
        labels = to[labels]
    outline = styles.label_boundary(labels)
    counts = kernels.skeleton_counts(outline)
    ink, regions = float(outline.mean()), len(np.unique(labels))
    return {"ink_coverage": ink, "dangling_endpoints": counts["endpoints"], "region_count": regions, "passed": 0.03 <= ink <= 0.08 and counts["endpoints"] == 0 and 40 <= regions <= 400}

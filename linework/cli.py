"""Command line: python -m linework.cli INPUT OUTPUT. INPUT is an image or a folder of images."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from .operators.gate import BadPage, Page
from .operators.styles import STYLES, ModelMissing
from .plans.compare import save_stages
from .plans.engine import DETAIL, DEVICES, Profile, convert, rendered, save

log = logging.getLogger("linework")

#: Exit codes; whatever has none of its own ends with FAILED.
OK, FAILED, UNSUPPORTED, TOO_LARGE, NO_MODEL, BAD_CHECKSUM, UNAVAILABLE, STRICT = 0, 1, 2, 3, 4, 5, 6, 7
BAD_ARGUMENTS = NOT_FOUND = FAILED
CODES = {"unsupported_image": UNSUPPORTED, "image_too_large": TOO_LARGE, "ModelMissing": NO_MODEL, "ChecksumError": BAD_CHECKSUM, "EngineUnavailable": UNAVAILABLE}
#: Styles that newer ones have replaced; they work, but are listed on request only.
EXPERIMENTAL = ("adaptive", "canny", "cartoon", "chained", "lineart", "skeleton", "xdog")


def parser(argv: list[str] | None = None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linework", description="Photos to printable line art.")
    p.add_argument("input")
    p.add_argument("output")
    listed = [s for s in sorted(STYLES) if "--show-experimental" in (argv or []) or s not in EXPERIMENTAL]
    p.add_argument("--style", choices=sorted(STYLES), metavar="{" + ",".join(listed) + "}")
    p.add_argument("--show-experimental", action="store_true", help="list all styles above")
    p.add_argument("--detail", choices=sorted(DETAIL))
    p.add_argument("--device", choices=DEVICES, help="where a network runs")
    p.add_argument("--debug-dir", help="write the stages of each image into this folder")
    p.add_argument("--jobs", type=int, help="tasks that convert at once")
    p.add_argument("--thickness", type=int, help="ignored; --detail says it in mm")
    p.add_argument("--verbose", action="store_true", help="log more, and show tracebacks")
    p.add_argument("--page-size")
    p.add_argument("--orientation", choices=("portrait", "landscape"))
    p.add_argument("--margin-mm", type=float)
    p.add_argument("--dpi", type=int)
    p.add_argument("--stroke-width-mm", type=float)
    p.add_argument("--max-pixels", type=int)
    p.add_argument("--max-dimension", type=int, dest="working_dimension", help="longer side that images are brought to")
    p.add_argument("--seed", type=int)
    p.add_argument("--profile", help="a JSON file; options override it")
    p.add_argument("--format", choices=("svg", "pdf", "png"))
    p.add_argument("--strict", action="store_true", help="write nothing that fails the quality gate")
    p.add_argument("--master", default="local[*]")
    return p


def profile_of(a: argparse.Namespace) -> Profile:
    base = Profile()
    if a.profile:
        with open(a.profile, encoding="utf-8") as f:
            base = Profile.from_json(f.read())
    given = {"size": a.page_size, "orientation": a.orientation, "margin_mm": a.margin_mm, "dpi": a.dpi, "stroke_width_mm": a.stroke_width_mm}
    page = Page(**{f: getattr(base.page, f) if given.get(f) is None else given[f] for f in Page.__dataclass_fields__})
    return base.with_overrides(page=page, style=a.style, detail=a.detail, max_pixels=a.max_pixels, working_dimension=a.working_dimension, seed=a.seed, device=a.device, debug_dir=a.debug_dir)


def main(argv: list[str] | None = None) -> int:
    a = parser(sys.argv[1:] if argv is None else argv).parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING, format="%(levelname)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if a.thickness is not None:
        log.warning("--thickness is ignored; use --detail")
    try:
        profile = profile_of(a)
    except (BadPage, ValueError, TypeError, OSError) as e:
        log.debug("bad arguments", exc_info=True)
        print(f"error: {e}", file=sys.stderr)
        return BAD_ARGUMENTS
    if not os.path.exists(a.input):
        print(f"error: {a.input} does not exist", file=sys.stderr)
        return NOT_FOUND
    from pyspark.sql import SparkSession

    from .sources.images import read_images

    spark = SparkSession.builder.master(f"local[{a.jobs}]" if a.jobs else a.master).config("spark.ui.enabled", "false").getOrCreate()
    folder = os.path.isdir(a.input)
    if not folder and os.path.splitext(a.input)[1].lower() not in (".jpg", ".jpeg", ".png"):
        print(f"error: {a.input} is no JPEG or PNG file", file=sys.stderr)
        return UNSUPPORTED
    images = read_images(spark, a.input)
    if profile.debug_dir:
        log.debug("%d stages written", save_stages(images, profile))
    done = convert(images, profile).persist()
    n_bad, n_failing, first = 0, 0, None
    for r in done.select("image_id", "error_class", "error_msg", "passed").where("error_class is not null or not coalesce(passed, false)").toLocalIterator():
        n_failing += 1
        if r.error_class:
            n_bad, first = n_bad + 1, first or r
            print(f"{r.image_id}: {r.error_class} {r.error_msg or ''}", file=sys.stderr)
    form = a.format or (os.path.splitext(a.output)[1][1:].lower() if not folder else "") or "png"
    good = done.where("passed") if a.strict else done
    if folder:
        save(rendered(good, profile.page, form), a.output, form)
    else:
        for r in rendered(good, profile.page, form).collect():
            os.makedirs(os.path.dirname(os.path.abspath(a.output)), exist_ok=True)
            with open(a.output, "wb") as f:
                f.write(r.content)
    if n_bad:
        return FAILED if folder else CODES.get(first.error_class, FAILED)
    return STRICT if a.strict and n_failing else OK


__all__ = ["ModelMissing", "main"]

if __name__ == "__main__":
    sys.exit(main())

"""Quality measures that need whole images: rendering onto a page, enclosed and leaking regions, boundary scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import kernels as k
from .styles import Drawing, Raster

SIZES = {"A4": (210.0, 297.0), "A5": (148.0, 210.0), "LETTER": (215.9, 279.4)}
LEAST_LEAK = 4
MM = 25.4


class BadPage(ValueError):
    """A page specification that cannot be."""


@dataclass(frozen=True)
class Page:
    """A size's name or (width, height) in mm; orientation counts for named sizes only."""

    size: object = "A4"
    orientation: str = "portrait"
    margin_mm: float = 10.0
    dpi: int = 300
    stroke_width_mm: float = 0.7

    def __post_init__(self):
        w, h = self.mm
        if min(w, h) <= 0 or self.dpi <= 0 or self.stroke_width_mm <= 0 or self.margin_mm < 0:
            raise BadPage("sizes must be positive")
        if 2 * self.margin_mm >= min(w, h):
            raise BadPage("the margins leave nothing of the page")

    @property
    def mm(self) -> tuple[float, float]:
        if not isinstance(self.size, str):
            return tuple(self.size)
        if self.size.upper() not in SIZES:
            raise BadPage(f"unknown page size {self.size!r}")
        w, h = SIZES[self.size.upper()]
        return (h, w) if self.orientation == "landscape" else (w, h)

    @property
    def pixels(self) -> tuple[int, int]:
        return tuple(round(v * self.dpi / MM) for v in self.mm)

    def fit(self, aspect: float) -> tuple[float, float, float]:
        """scale and offsets in mm that centre an image of that aspect within the margins."""
        w, h = self.mm
        cw, ch = (1.0, 1 / aspect) if aspect >= 1 else (aspect, 1.0)
        scale = min((w - 2 * self.margin_mm) / cw, (h - 2 * self.margin_mm) / ch)
        return scale, (w - cw * scale) / 2, (h - ch * scale) / 2


def to_png(art: Drawing | Raster, page: Page) -> np.ndarray:
    """The whole page as gray pixels."""
    w, h = page.pixels
    scale, dx, dy = (v * page.dpi / MM for v in page.fit(art.aspect))
    if isinstance(art, Raster):
        out = np.full((h, w), 255, np.uint8)
        aw, ah = (scale, scale / art.aspect) if art.aspect >= 1 else (scale * art.aspect, scale)
        y, x, ah, aw = round(dy), round(dx), max(1, round(ah)), max(1, round(aw))
        part = np.clip(np.rint(k.resize(art.image.astype(float), ah, aw)), 0, 255).astype(np.uint8)
        out[y : y + ah, x : x + aw] = part[: h - y, : w - x]
        return out
    return k.draw(art.paths, h, w, scale, (dx, dy), max(1, round(page.stroke_width_mm * page.dpi / MM)))


def to_svg(art: Drawing | Raster, page: Page) -> str:
    """One unit is one mm."""
    import base64

    w, h = page.mm
    scale, dx, dy = page.fit(art.aspect)
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:g}mm" height="{h:g}mm" viewBox="0 0 {w:g} {h:g}">'
    if isinstance(art, Raster):
        aw, ah = (scale, scale / art.aspect) if art.aspect >= 1 else (scale * art.aspect, scale)
        data = base64.b64encode(k.png(art.image)).decode()
        return f'{head}<image x="{dx:.3f}" y="{dy:.3f}" width="{aw:.3f}" height="{ah:.3f}" href="data:image/png;base64,{data}"/></svg>'
    lines = []
    for points, closed in art.paths:
        at = " L".join(f"{x * scale + dx:.3f},{y * scale + dy:.3f}" for x, y in points.astype(float).tolist())
        lines.append(f'<path d="M{at}{" Z" if closed else ""}"/>')
    return f'{head}<g fill="none" stroke="black" stroke-width="{page.stroke_width_mm:g}" stroke-linecap="round" stroke-linejoin="round">{"".join(lines)}</g></svg>'


def to_pdf(art: Drawing | Raster, page: Page) -> bytes:
    """A PDF of one page; y runs upwards there."""
    import zlib

    w, h = (v * 72 / MM for v in page.mm)
    scale, dx, dy = (v * 72 / MM for v in page.fit(art.aspect))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"]
    resources = b""
    if isinstance(art, Raster):
        aw, ah = (scale, scale / art.aspect) if art.aspect >= 1 else (scale * art.aspect, scale)
        content = f"q {aw:.3f} 0 0 {ah:.3f} {dx:.3f} {h - dy - ah:.3f} cm /I Do Q".encode()
        resources = b"/XObject << /I 5 0 R >>"
    else:
        parts = [f"{page.stroke_width_mm * 72 / MM:.3f} w 1 J 1 j"]
        for points, closed in art.paths:
            at = [f"{x * scale + dx:.3f} {h - y * scale - dy:.3f}" for x, y in points.astype(float).tolist()]
            parts.append(f"{at[0]} m " + " ".join(f"{p} l" for p in at[1:]) + (" s" if closed else " S"))
        content = "\n".join(parts).encode()
    objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Contents 4 0 R /Resources << %s >> >>" % (w, h, resources))
    objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
    if isinstance(art, Raster):
        data = zlib.compress(art.image.tobytes())
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (art.image.shape[1], art.image.shape[0], len(data), data))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


@dataclass
class Report:
    """Measures of a page; None is not applicable and does not count."""

    ink_coverage: float
    enclosed_regions: int
    leaking_regions: int | None
    min_region_area_mm2: float | None
    region_area_mm2_p5: float | None
    dangling_endpoints: int | None
    antialiased_fraction: float | None
    limits: dict = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        at = {"ink": (0.03, 0.08), "leaking": 0, "dangling": 0, "area": 1.0, "antialiased": 0.05} | self.limits
        return bool(
            at["ink"][0] <= self.ink_coverage <= at["ink"][1]
            and (self.leaking_regions is None or self.leaking_regions <= at["leaking"])
            and (self.dangling_endpoints is None or self.dangling_endpoints <= at["dangling"])
            and (self.min_region_area_mm2 is None or self.min_region_area_mm2 >= at["area"])
            and (self.antialiased_fraction is None or self.antialiased_fraction >= at["antialiased"])
        )


def _areas(ink: np.ndarray) -> np.ndarray:
    """Pixels of each enclosed region; regions touch over corners, the outside does not."""
    labels, n = k.components(~ink & ~k.reached(ink))
    return np.bincount(labels.ravel(), minlength=n + 1)[1:]


def validate(art: Drawing | Raster, page: Page, **limits) -> Report:
    image = to_png(art, page)
    raster = isinstance(art, Raster)
    ink = image < 128
    areas = _areas(k.close_mask(ink) if raster else ink) * (MM / page.dpi) ** 2
    leaking = dangling = None
    if not raster:
        shut = to_png(Drawing([(p, True) for p, _ in art.paths], art.aspect), page) < 128
        leak = k.reached(ink) & ~shut & ~k.reached(shut)
        labels, n = k.components(leak)
        leaking = int((np.bincount(labels.ravel(), minlength=n + 1)[1:] >= LEAST_LEAK).sum())
        dangling = sum(2 for _, closed in art.paths if not closed)
    return Report(
        float(ink.mean()),
        len(areas),
        leaking,
        float(areas.min()) if len(areas) else None,
        float(np.percentile(areas, 5)) if len(areas) else None,
        dangling,
        float(((image > 5) & (image < 250)).mean()) if raster else None,
        limits,
    )


# --- diagnostic measures of rasters


def line_metrics(image: np.ndarray, least_extent: int = 4) -> dict:
    """Ink share, components of ink, the median of their extents, and the share of ink in small ones."""
    ink = image < 128
    labels, n = k.components(ink)
    size = k.extents(labels, n) if n else np.empty(0, int)
    area = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    return {"ink_coverage": float(ink.mean()), "component_count": n, "median_stroke_length": float(np.median(size)) if n else 0.0, "noise_fraction": float(area[size < least_extent].sum() / area.sum()) if n else 0.0}


def _scores(predicted: np.ndarray, reference: np.ndarray, tolerance: float) -> tuple[float, float, float]:
    if not predicted.any() or not reference.any():
        return 0.0, 0.0, 0.0
    p = float((k.distance(~reference)[predicted] <= tolerance).mean())
    r = float((k.distance(~predicted)[reference] <= tolerance).mean())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def compare_boundaries(predicted: np.ndarray, reference: np.ndarray, tolerance: float | None = None, dark: int = 160) -> dict:
    """Precision, recall and F1 of thinned ink within a tolerance (0.5 % of the longer side, 2 pixels at least), F1 above that
    of an all-black page, and whether the ink share lies between 3 and 7 %."""
    t = max(2, round(0.005 * max(reference.shape))) if tolerance is None else tolerance
    a, b = k.thin(predicted < dark), k.thin(reference < dark)
    p, r, f = _scores(a, b, t)
    _, _, floor = _scores(k.thin(np.ones(reference.shape, bool)), b, t)
    normalized = 0.0 if floor >= 1 else min(1.0, max(0.0, (f - floor) / (1 - floor)))
    return {"precision": p, "recall": r, "f1": f, "f1_normalized": normalized, "ink_admissible": bool(0.03 <= (predicted < dark).mean() <= 0.07)}

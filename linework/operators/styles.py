"""Styles: what turns a BGR image into line art. A style returns a Drawing, its paths in shares of the longer
side, or a Raster. Styles that rest on a trained network take the network as a function; none is bundled.

``model`` functions get an RGB image and return a gray response of the same size; ``masks`` functions get a BGR image
and return (segmentation, area) pairs. A style that lacks its function raises ModelMissing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import kernels as k


class ModelMissing(RuntimeError):
    """The style needs a network that the caller did not give."""


class EngineUnavailable(RuntimeError):
    """A library that the caller's network needs is not there; functions that load networks raise it."""


@dataclass
class Drawing:
    paths: list[tuple[np.ndarray, bool]]
    aspect: float
    kind: str = "boundary"
    kinds: list[str] | None = None
    areas: list[float | None] | None = None
    stages: list[tuple[str, np.ndarray]] = field(default_factory=list)


@dataclass
class Raster:
    image: np.ndarray
    aspect: float
    stages: list[tuple[str, np.ndarray]] = field(default_factory=list)


def kernel_size(dimension: int, fraction: float, least: int = 3, odd: bool = True) -> int:
    n = max(least, round(dimension * fraction))
    return n + 1 if odd and n % 2 == 0 else n


def _drawing(image: np.ndarray, paths, shortest_px: float, **more) -> Drawing:
    h, w = image.shape[:2]
    least = shortest_px / max(h, w)
    return Drawing([p for p in paths if k.path_length(*p) >= least], w / h, **more)


def _denoised(image: np.ndarray) -> np.ndarray:
    return np.rint(k.bilateral(k.to_gray(image), 4, 75, 75)).astype(np.uint8)


def _thresholds(gray: np.ndarray, percentile: float) -> tuple[float, float]:
    high = float(np.percentile(np.hypot(*k.sobel(gray)), percentile))
    return 0.4 * high, high


def canny(image: np.ndarray, low: float | None = None, high: float | None = None) -> Drawing:
    gray = _denoised(image)
    if low is None or high is None:
        low, high = _thresholds(gray, 92.5)
    long = max(gray.shape)
    edges = k.close_mask(k.canny(gray, low, high), kernel_size(long, 0.002) // 2)
    return _drawing(image, k.trace(edges), kernel_size(long, 0.012, odd=False), stages=[("denoised", gray), ("edges", edges)])


def adaptive(image: np.ndarray, block: int = 9, c: float = 2) -> Drawing:
    gray = _denoised(image)
    r = (block | 1) // 2
    p = np.pad(gray.astype(float), r, mode="edge")
    h, w = gray.shape
    mean = sum(p[dy : dy + h, dx : dx + w] for dy in range(2 * r + 1) for dx in range(2 * r + 1)) / (2 * r + 1) ** 2
    ink = gray <= np.rint(mean) - c
    return _drawing(image, k.trace(ink), 4, stages=[("denoised", gray), ("ink", ink)])


def xdog(image: np.ndarray, sigma: float = 1.0, ratio: float = 1.6, sharpness: float = 25.0, epsilon: float = 0.1, phi: float = 40.0) -> Drawing:
    """Winnemoeller and others 2012."""
    gray = _denoised(image) / 255.0
    long = max(gray.shape)
    s = max(0.3, sigma * long / 1400)
    d = (1 + sharpness) * k.gaussian(gray, s) - sharpness * k.gaussian(gray, s * ratio)
    soft = np.clip(np.where(d >= epsilon, 1.0, 1 + np.tanh(phi * (d - epsilon))), 0, 1)
    ink = (soft * 255).astype(np.uint8) < 255
    return _drawing(image, k.trace(ink), kernel_size(long, 0.012, odd=False), stages=[("soft", (soft * 255).astype(np.uint8))])


def cartoon(image: np.ndarray, radius: int = 25, color: float = 48, shortest: int = 6) -> Drawing:
    """Edges of a mean-shift image. Mean shift runs on half the size, as with one level of a pyramid."""
    h, w = image.shape[:2]
    small = k.resize(image, max(1, h // 2), max(1, w // 2))
    flat = k.resize(k.mean_shift(small, max(1, radius // 2), color), h, w)
    gray = k.to_gray(np.clip(np.rint(flat), 0, 255).astype(np.uint8)).astype(int)
    cross = [k.shifted(gray, dy, dx, -1) for dy, dx in k.FOUR] + [gray]
    inside = [np.where(a < 0, gray, a) for a in cross]
    edges = np.maximum.reduce(inside) - np.minimum.reduce(inside) > 10
    return _drawing(image, k.trace(edges), shortest, stages=[("segmented", gray), ("edges", edges)])


def skeleton(image: np.ndarray, strength: float = 0.02, percentile: float = 95.0, epsilon: float = 1.2, shortest: int = 15) -> Drawing:
    gray = k.to_gray(np.rint(k.l0_smooth(image, strength)).astype(np.uint8))
    edges = k.canny(gray, *_thresholds(gray, percentile))
    long = max(gray.shape)
    paths = [(k.simplify(p, epsilon / long, c), c) for p, c in k.trace(edges)]
    return _drawing(image, paths, shortest, stages=[("flattened", gray), ("edges", edges)])


def meaningful(chains: list[np.ndarray], magnitude: np.ndarray, most: float = 1.0) -> list[np.ndarray]:
    """The a-contrario test of Desolneux, Moisan and Morel 2001: chains whose least gradient would come about by chance
    in fewer than ``most`` of all pieces of chains. Neighbouring pixels depend on each other, so every second counts."""
    sizes = [len(c) for c in chains]
    tests = max(1.0, sum(n * (n - 1) / 2 for n in sizes))
    ranked = np.sort(magnitude.ravel())
    kept = []
    for c in chains:
        x, y = np.rint(c).astype(int).T
        least = magnitude[np.clip(y, 0, magnitude.shape[0] - 1), np.clip(x, 0, magnitude.shape[1] - 1)].min()
        tail = (len(ranked) - np.searchsorted(ranked, least)) / len(ranked)
        if np.log(tests) + len(c) / 2 * np.log(max(tail, 1e-300)) <= np.log(most):
            kept.append(c)
    return kept


def filled(points: np.ndarray) -> np.ndarray:
    """All pixels along a chain of straight runs."""
    out = [points[:1]]
    for a, b in zip(points[:-1], points[1:], strict=True):
        n = max(1, int(np.abs(b - a).max().round()))
        out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
    return np.vstack(out)


def edge_chains(image: np.ndarray, gradient: float = 36.0, anchor: float = 8.0, shortest: int = 30, sigma: float = 1.5, validated: bool = True) -> list[np.ndarray]:
    """Chains of edge pixels (x, y), after Topal and Akinlar 2012 in spirit: of a rolling-guidance image the ridge of the
    gradient where it exceeds the threshold, kept where joined to an anchor that stands out from both sides, thinned
    and traced. Chains under ``shortest`` pixels go, and those that are not meaningful."""
    gray = k.to_gray(image).astype(float)
    smooth = k.gaussian(k.rolling_guidance(gray), sigma)
    gx, gy = k.sobel(smooth)
    m = np.abs(gx) + np.abs(gy)
    across = np.abs(gx) >= np.abs(gy)
    a, b = (np.where(across, k.shifted(m, 0, d, -1.0), k.shifted(m, d, 0, -1.0)) for d in (-1, 1))
    ridge = (m >= gradient) & (m >= a) & (m > b)
    chains = []
    for points, closed in k.trace(k.joined(ridge & (m - a >= anchor) & (m - b >= anchor), ridge)):
        p = points * max(gray.shape)
        if k.path_length(p, closed) >= shortest:
            chains.append(filled(np.vstack([p, p[:1]]) if closed else p))
    return meaningful(chains, m) if validated else chains


def _chain_drawing(image: np.ndarray, chains: list[np.ndarray], epsilon: float) -> Drawing:
    long = max(image.shape[:2])
    paths = [(k.simplify(c / long, epsilon / long), False) for c in chains]
    return _drawing(image, paths, kernel_size(long, 0.012, odd=False))


def chained(image: np.ndarray, epsilon: float = 1.2) -> Drawing:
    return _chain_drawing(image, edge_chains(image), epsilon)


def color_labels(image: np.ndarray, step: int = 4) -> np.ndarray:
    """Labels of equal quantised colour in the order of (b, g, r)."""
    q = image.astype(int) // step
    _, labels = np.unique(q.reshape(-1, q.shape[2]), axis=0, return_inverse=True)
    return labels.reshape(image.shape[:2])


def label_means(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    size = np.maximum(np.bincount(labels.ravel()), 1)
    return np.stack([np.bincount(labels.ravel(), values[..., c].ravel()) / size for c in range(values.shape[2])], 1)


def label_boundary(labels: np.ndarray) -> np.ndarray:
    """Pixels beside another label, on both sides."""
    out = np.zeros(labels.shape, bool)
    out[:, 1:] |= labels[:, 1:] != labels[:, :-1]
    out[:, :-1] |= labels[:, 1:] != labels[:, :-1]
    out[1:] |= labels[1:] != labels[:-1]
    out[:-1] |= labels[1:] != labels[:-1]
    return out


def with_contrast(boundary: np.ndarray, labels: np.ndarray, lab: np.ndarray, least: float) -> np.ndarray:
    """Boundary pixels with a four-neighbour in a region whose mean colour is far enough."""
    mean = label_means(lab, labels)[labels]
    strong = np.zeros(labels.shape, bool)
    for dy, dx in k.FOUR:
        inside = k.shifted(np.ones(labels.shape, bool), dy, dx, False)
        strong |= inside & (np.sqrt(((k.shifted(mean, dy, dx) - mean) ** 2).sum(2)) >= least)
    return boundary & strong


def pair_of(path: np.ndarray, labels: np.ndarray) -> tuple[int, int] | None:
    """Walking along the points the first two labels or more met beside a point: the two smallest; none if only one."""
    seen: set[int] = set()
    h, w = labels.shape
    for x, y in np.rint(path).astype(int).tolist():
        seen |= {int(labels[y + dy, x + dx]) for dy, dx in [(0, 0), *k.EIGHT] if 0 <= y + dy < h and 0 <= x + dx < w}
        if len(seen) > 1:
            return tuple(sorted(seen)[:2])
    return None


def region(image: np.ndarray, segmentation: str = "mean_shift", detection: str = "gradient", percentile: float = 94.0, contrast: float = 8.0, color: float = 20, superpixels: int = 500, epsilon: float = 1.2) -> Drawing:
    """Outlines between regions of differing colour; each path's source_area is the smaller region's share of the image."""
    h, w = image.shape[:2]
    long = max(h, w)
    flat = np.rint(k.l0_smooth(image)).astype(np.uint8)
    lab = k.to_lab(flat)
    if segmentation == "mean_shift":
        labels = color_labels(np.rint(k.mean_shift(flat, kernel_size(long, 0.01, 5, odd=False), color)).astype(np.uint8))
    elif segmentation == "slic":
        labels = k.slic(lab, superpixels)
    elif segmentation == "seeds":
        labels = k.seeds(flat, superpixels)
    else:
        raise ValueError(f"unknown segmentation {segmentation!r}")
    if detection == "labels":
        edge = label_boundary(labels)
    elif detection == "gradient":
        m = np.sqrt(sum(g * g for c in range(3) for g in k.sobel(lab[..., c])))
        edge = (m >= np.percentile(m, percentile)) & (m > 0)
    else:
        raise ValueError(f"unknown boundary detection {detection!r}")
    edge = with_contrast(edge, labels, lab, contrast)
    area = np.bincount(labels.ravel())
    out = Drawing([], w / h, areas=[], stages=[("flattened", flat), ("boundary", edge)])
    for points, closed in k.trace(edge):
        if k.path_length(points, closed) * long >= kernel_size(long, 0.014, 10, odd=False):
            pair = pair_of(points * long, labels)
            out.areas.append(None if pair is None else float(min(area[list(pair)]) / labels.size))
            out.paths.append((k.simplify(points, epsilon / long, closed), closed))
    return out


# --- styles on a network given by the caller


def by_short_side(h: int, w: int, resolution: int, multiple: int = 64) -> tuple[int, int, int, int]:
    """Height and width of what a network sees, and of its part that is image: the shorter side near ``resolution``, both
    rounded to multiples, each by itself."""
    h, w = (max(multiple, round(x * resolution / min(h, w) / multiple) * multiple) for x in (h, w))
    return h, w, h, w


def by_long_side(h: int, w: int, resolution: int, multiple: int = 256) -> tuple[int, int, int, int]:
    """The same with the longer side at ``resolution`` and the rest up to the next multiples for a mirrored border."""
    own = [max(1, round(x * resolution / max(h, w))) for x in (h, w)]
    return *(-(-x // multiple) * multiple for x in own), *own


#: Pixels of a network's input beyond which it gets the image in strips across the longer side, as a very long, narrow image has
#: very many with its shorter side at the network's resolution.
STRIP_PIXELS = 4_000_000
#: Rows of a strip that are resized at once.
BAND_ROWS = 64


def _response(image: np.ndarray, model: Callable | None, resolution: int | None = None, sized: Callable = by_short_side) -> np.ndarray:
    """The model's gray response to the image brought to the size that ``sized`` says, in the image's own size. A border
    mirrors the image with its edge and is cut off again. An input of more than STRIP_PIXELS without a border is made, shown to the model and
    brought back in strips, each with a quarter of the input's width of its neighbours on either side: the whole result for a model that
    looks no further than that."""
    if model is None:
        raise ModelMissing("this style needs a model")
    h, w = image.shape[:2]
    rgb = image[..., ::-1]
    if resolution:
        full_h, full_w, own_h, own_w = sized(h, w, resolution)
        if full_h * full_w > STRIP_PIXELS and (full_h, full_w) == (own_h, own_w) and (own_h >= h if own_h >= own_w else own_w >= w):
            return _in_strips(rgb, model, own_h, own_w) if own_h >= own_w else _in_strips(rgb.transpose(1, 0, 2), lambda x: _gray(model(np.ascontiguousarray(x.transpose(1, 0, 2)))).T, own_w, own_h).T
        rgb = np.clip(np.rint(k.resize(rgb, own_h, own_w)), 0, 255).astype(np.uint8)
        rgb = np.pad(rgb, ((0, full_h - own_h), (0, full_w - own_w), (0, 0)), mode="symmetric")
    out = np.asarray(model(np.ascontiguousarray(rgb)))
    if resolution and out.shape[:2] == (full_h, full_w):
        out = out[:own_h, :own_w]
    return np.clip(np.rint(k.resize(_gray(out).astype(float), h, w)), 0, 255).astype(np.uint8)


def _gray(out: np.ndarray) -> np.ndarray:
    out = np.asarray(out)
    return k.to_gray(out[..., ::-1]) if out.ndim == 3 else out


def _in_strips(rgb: np.ndarray, model: Callable, own_h: int, own_w: int) -> np.ndarray:
    """_response() of an image whose rows grow to ``own_h``: strips of its rows, each brought to the network's size by itself. A row
    of the result is the mean of the network's rows that lie in it."""
    h, w = rgb.shape[:2]
    scale = own_h / h
    step = max(1, int(STRIP_PIXELS / own_w / scale / 3))
    out = np.empty((h, w), np.uint8)
    for start in range(0, h, step):
        stop = min(h, start + step)
        low, high = int(np.floor(start * scale)), int(np.ceil(stop * scale))
        # the network's rows of the strip, and its neighbours'
        first, last = max(0, low - own_w // 4), min(own_h, high + own_w // 4)
        at = np.clip((np.arange(first, last) + 0.5) * h / own_h - 0.5, 0, h - 1)
        up = np.minimum(at.astype(int), h - 1)
        part = (at - up)[:, None, None]
        seen = np.empty((last - first, own_w, rgb.shape[2]), np.uint8)
        for a in range(0, last - first, BAND_ROWS):  # as floats only a few rows at a time
            some = slice(a, a + BAND_ROWS)
            rows = k.resize(rgb[up[some]] * (1 - part[some]) + rgb[np.minimum(up[some] + 1, h - 1)] * part[some], len(up[some]), own_w)
            seen[some] = np.clip(np.rint(rows), 0, 255)
        made = _gray(model(seen)).astype(float)
        if made.shape[0] != last - first:
            made = k.resize(made, last - first, own_w)
        # area by area, as resize() does where it shrinks
        edges = np.linspace(start, stop, stop - start + 1) * scale - first
        sums = np.concatenate([np.zeros((1, made.shape[1])), np.cumsum(made, 0)])
        lo = np.minimum(edges.astype(int), last - first - 1)
        narrow = np.diff(sums[lo] + made[lo] * (edges - lo)[:, None], axis=0) / scale
        out[start:stop] = np.clip(np.rint(k.resize(narrow, stop - start, w)), 0, 255).astype(np.uint8)
    return out


def centerline(gray: np.ndarray, strong: float = 80, weak: float = 160, least_branch: int = 15) -> np.ndarray:
    """Skeleton of dark lines by two thresholds, without short branches."""
    return k.prune_branches(k.thin(k.joined(gray <= strong, gray <= weak)), least_branch)


def gradient_edges(gray: np.ndarray, percentile: float = 90) -> np.ndarray:
    """Both flanks of soft lines."""
    return k.canny(gray, *_thresholds(gray, percentile))


def soft_lines(image: np.ndarray, model: Callable | None = None, resolution: int | None = None, exponent: float = 1.0, edges: str = "hysteresis", sized: Callable = by_short_side) -> Drawing:
    """Centre lines of a network's sketch, darker with an exponent under 1."""
    soft = k.normalize(_response(image, model, resolution, sized))
    if exponent != 1:
        soft = (255 * (soft / 255.0) ** exponent).astype(np.uint8)
    mask = centerline(soft) if edges == "hysteresis" else gradient_edges(soft)
    return _drawing(image, k.trace(mask), kernel_size(max(mask.shape), 0.012, odd=False), kind="detail", stages=[("soft", soft), ("lines", mask)])


def anime2sketch(image: np.ndarray, model: Callable | None = None) -> Drawing:
    return soft_lines(image, model, 512, 1 / 1.6, sized=by_long_side)


def informative_drawings(image: np.ndarray, model: Callable | None = None) -> Drawing:
    return soft_lines(image, model, 512)


def gated(image: np.ndarray, model: Callable | None = None, least: float = 40.0, radius: int = 2, epsilon: float = 1.2) -> Drawing:
    """Edge chains along which the network's sketch is dark enough on average."""
    soft = k.normalize(_response(image, model)).astype(float)
    kept = []
    for chain in edge_chains(image):
        line = k.draw([(chain, False)], *soft.shape, 1.0) < 128
        near = np.logical_or.reduce([k.shifted(line, dy, dx, False) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
        if near.any() and 255 - soft[near].mean() >= least:
            kept.append(chain)
    return _chain_drawing(image, kept, epsilon)


def smallest_mask_labels(shape: tuple[int, int], masks: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Each pixel gets the smallest mask that covers it, later ones of equal area first; pixels under none the nearest label."""
    labels = np.full(shape, -1, np.int32)
    for i, (segmentation, _) in sorted(enumerate(masks), key=lambda x: (-x[1][1], x[0])):
        labels[np.asarray(segmentation, bool)] = i
    known = labels >= 0
    labels = k.nearest_labels(labels, known) if known.any() else np.zeros(shape, np.int32)
    return np.unique(labels, return_inverse=True)[1].reshape(shape)


def chaikin(points: np.ndarray, closed: bool, rounds: int = 2) -> np.ndarray:
    for _ in range(rounds):
        if len(points) < 3:
            break
        a, b = (points, np.roll(points, -1, 0)) if closed else (points[:-1], points[1:])
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
        points = cut if closed else np.vstack([points[:1], cut, points[-1:]])
    return points


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return float(max(d.min(1).max(), d.min(0).max()))


def lineart(image: np.ndarray, masks: Callable | None = None, model: Callable | None = None, least_area_mm2: float = 4.0, contrast: float = 8.0, detail: float = 128.0, shortest_mm: float = 2.0, near_mm: float = 1.0, epsilon_px: float = 1.2, dpi: float = 300.0) -> Drawing:
    """Boundaries of segments that are large or contrasting, and a network's detail lines within them; details that repeat a
    boundary go. Lines are simplified, smoothed, and dropped if short."""
    if masks is None:
        raise ModelMissing("this style needs a function that gives masks")
    h, w = image.shape[:2]
    long = max(h, w)
    labels = smallest_mask_labels((h, w), list(masks(image)))
    response = k.normalize(255 - _response(image, model))
    mean, area = label_means(k.to_lab(image), labels), np.bincount(labels.ravel())
    found, kept = [], set()
    for label in range(len(area)):
        own = labels == label
        rim = own & ~np.logical_and.reduce([k.shifted(own, dy, dx, True) for dy, dx in k.FOUR])
        for points, closed in k.trace(rim):
            pair = pair_of(points * long, labels)
            if pair and pair[0] == label and (min(area[list(pair)]) >= least_area_mm2 * (dpi / 25.4) ** 2 or np.linalg.norm(mean[pair[0]] - mean[pair[1]]) >= contrast):
                found.append((points, closed, "boundary"))
                kept |= set(pair)
    inside = np.isin(labels, sorted(kept))
    found += [(p, c, "detail") for p, c in k.trace(inside & centerline(response, detail, min(255, detail + 60)))]
    smooth = [(chaikin(k.simplify(p, epsilon_px / long, c), c).astype(np.float32), c, kind) for p, c, kind in found]
    smooth = [x for x in smooth if len(x[0]) > 1 and k.path_length(*x[:2]) >= shortest_mm * dpi / 25.4 / long]
    edges = [x for x in smooth if x[2] == "boundary"]
    details = [x for x in smooth if x[2] == "detail" and not any(hausdorff(x[0], e[0]) < near_mm * dpi / 25.4 / long for e in edges)]
    every = edges + details
    return Drawing([(p, c) for p, c, _ in every], w / h, kinds=[kind for *_, kind in every], stages=[("segments", labels), ("detail", response)])


def lineart_raster(image: np.ndarray, model: Callable | None = None, resolution: int = 1024, invert: bool = False, exponent: float = 1.0) -> Raster:
    """The network's response (white lines on black) as dark lines on white, antialiased."""
    out = 255 - _response(image, model, resolution)
    if exponent != 1:
        out = np.clip(255 - 255 * ((255.0 - out) / 255) ** exponent, 0, 255).astype(np.uint8)
    return Raster(255 - out if invert else out, image.shape[1] / image.shape[0], [("response", out)])


STYLES: dict[str, Callable] = {"adaptive": adaptive, "anime2sketch": anime2sketch, "canny": canny, "cartoon": cartoon, "chained": chained, "gated": gated, "informative_drawings": informative_drawings, "lineart": lineart, "lineart-raster": lineart_raster, "region": region, "skeleton": skeleton, "xdog": xdog}


def register(name: str, style: Callable) -> None:
    """Add a style of one's own."""
    STYLES[name] = style


def get(name: str) -> Callable:
    if name not in STYLES:
        raise KeyError(f"unknown style {name!r}; known: {', '.join(sorted(STYLES))}")
    return STYLES[name]

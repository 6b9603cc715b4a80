"""Kernels and styles against hand-computed cases and the properties they must have."""

import zlib

import numpy as np
import pytest

from linework.operators import gate, styles
from linework.operators import kernels as k


def grid(n):
    return np.mgrid[0:n, 0:n]


def ring(n, r, t, cy=None, cx=None):
    y, x = grid(n)
    return np.abs(np.hypot(y - (cy or n // 2), x - (cx or n // 2)) - r) <= t / 2


def photo():
    y, x = np.mgrid[0:48, 0:64]
    a = np.stack([x * 4] * 3, -1).astype(np.uint8)
    a[8:24, 8:28] = 10
    a[np.hypot(y - 32, x - 46) < 10] = 240
    return a


def test_components_and_noise():
    a = np.full((20, 20), 255, np.uint8)
    a[0:6, 0:6] = a[10:16, 10:16] = a[19, 19] = 0
    m = gate.line_metrics(a)
    assert m["component_count"] == 3 and m["median_stroke_length"] == 6 and m["noise_fraction"] == pytest.approx(1 / 73)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_as_by_flooding(connectivity):
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < 0.5
        labels, n = k.components(m, connectivity)
        want, count = np.zeros(m.shape, int), 0
        for p in np.argwhere(m):
            if want[tuple(p)]:
                continue
            count += 1
            todo = [tuple(p)]
            want[todo[0]] = count
            while todo:
                y, x = todo.pop()
                for dy, dx in k.EIGHT if connectivity == 8 else k.FOUR:
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and not want[q]:
                        want[q] = count
                        todo.append(q)
        assert n == count and (labels == want).all()


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    m = rng.random((17, 23)) < 0.9
    off = np.argwhere(~m)
    d = k.distance(m)
    for y, x in np.argwhere(m):
        assert d[y, x] == pytest.approx(np.sqrt(((off - [y, x]) ** 2).sum(1).min()))


def test_boundary_scores():
    a, b = np.full((30, 30), 255, np.uint8), np.full((30, 30), 255, np.uint8)
    a[15, 16] = b[15, 15] = 0
    assert gate.compare_boundaries(a, b, 2)["f1"] == 1
    assert gate.compare_boundaries(a, b, 0)["f1"] == 0
    blank = np.full((10, 10), 255, np.uint8)
    assert gate.compare_boundaries(blank, blank) == {"precision": 0, "recall": 0, "f1": 0, "f1_normalized": 0, "ink_admissible": False}


def test_degenerate_pages_score_near_nothing():
    ref = np.full((216, 162), 255, np.uint8)
    ref[40:170, 30:33] = ref[40:170, 120:123] = ref[40:43, 30:123] = ref[167:170, 30:123] = 0
    assert gate.compare_boundaries(np.zeros_like(ref), ref)["f1_normalized"] <= 0.05
    assert gate.compare_boundaries(np.roll(ref, 1, 1), ref)["f1_normalized"] > 0.8


def test_hysteresis():
    a = np.full((30, 30), 240)
    a[10, 10:20], a[10, 20:24], a[25, 25] = 5, 90, 90
    kept = k.joined(a <= 20, a <= 100)
    assert kept[10, 10:24].all() and kept.sum() == 14


def test_branches():
    m = np.zeros((20, 30), bool)
    m[10] = True
    m[10:14, 15] = True
    lean = k.prune_branches(m, 6)
    assert not lean[12:14, 15].any() and lean[10].all()
    m = np.zeros((25, 30), bool)
    m[10] = True
    m[10:20, 15] = True
    assert k.prune_branches(m, 6)[15:20, 15].all()


@pytest.mark.parametrize("width", [2, 6, 12])
def test_one_centre_line(width):
    a = np.full((60, 120), 255, np.uint8)
    a[30 - width // 2 : 30 - width // 2 + width, 10:110] = 0
    line = styles.centerline(a)
    assert (line[:, 20:100].sum(0) == 1).all()


def test_flat_image_becomes_white():
    assert (k.normalize(np.full((10, 10), 100, np.uint8)) == 255).all()


def test_plus_and_t():
    m = np.zeros((60, 60), bool)
    m[29:32, 5:55] = m[5:55, 29:32] = True
    assert [c for _, c in k.trace(m)] == [False, False]
    m = np.zeros((60, 60), bool)
    m[10:13, 5:55] = m[10:58, 29:32] = True
    lengths = sorted(k.path_length(p, c) * 60 for p, c in k.trace(m))
    assert len(lengths) == 2 and abs(lengths[0] - 45) <= 4 and abs(lengths[1] - 48) <= 4


@pytest.mark.parametrize("t", [1, 3, 5])
def test_circle_is_one_closed_path(t):
    ((p, closed),) = k.trace(ring(120, 40, t))
    assert closed and k.path_length(p, closed) * 120 == pytest.approx(2 * np.pi * 40, rel=0.1)


def test_three_shapes():
    m = ring(200, 20, 3, 40, 40) | ring(200, 25, 3, 120, 60) | ring(200, 15, 3, 100, 150)
    assert [c for _, c in k.trace(m)] == [True] * 3


def test_no_collinear_point_remains():
    y, x = grid(100)
    arc = (np.abs(np.hypot((y - 90) / 0.7, x - 50) - 40) <= 1.5) & (y < 80)
    ((p, closed),) = k.trace(arc)
    q = np.rint(p * 100)
    a, b = np.diff(q, axis=0)[:-1], np.diff(q, axis=0)[1:]
    assert not closed and not ((a[:, 0] * b[:, 1] == a[:, 1] * b[:, 0]) & ((a * b).sum(1) > 0)).any()


def test_lengths_and_simplification():
    p = np.array([(0, 0), (3, 4), (3, 0)], float)
    assert k.path_length(p, False) == 9 and k.path_length(p, True) == 12
    line = np.c_[np.arange(50), np.sin(np.arange(50)) * 0.2]
    assert len(k.simplify(line, 0.5)) == 2
    square = np.array([(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10)], float)
    assert len(k.simplify(square, 0.1, True)) == 4


def test_chaikin():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    cut = styles.chaikin(square, True, 1)
    assert len(cut) == 8 and not any((cut == c).all(1).any() for c in square)
    bent = np.array([(0, 0), (5, 5), (10, 0)], float)
    twice = styles.chaikin(bent, False, 2)
    assert (twice[[0, -1]] == bent[[0, -1]]).all() and (styles.chaikin(bent, False, 0) == bent).all()


def test_labels_boundaries_and_contrast():
    a = np.zeros((60, 60, 3), np.uint8)
    a[:, :30], a[:, 30:] = 20, 220
    labels = styles.color_labels(a)
    assert labels[0, 0] == labels[59, 29] != labels[0, 59]
    labels = np.zeros((10, 10), int)
    labels[:, 5:] = 1
    edge = styles.label_boundary(labels)
    assert np.flatnonzero(edge[3]).tolist() == [4, 5]
    lab = np.zeros((10, 10, 3))
    lab[:, 5:, 0] = 200
    assert styles.with_contrast(edge, labels, lab, 50).sum() == 20
    assert not styles.with_contrast(edge, labels, lab / 200, 50).any()


PAGE = gate.Page(size=(50.0, 50.0), margin_mm=5, dpi=100)


def circle(gap=0):
    t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    p = np.c_[0.5 + 0.4 * np.cos(t), 0.5 + 0.4 * np.sin(t)].astype(np.float32)
    return styles.Drawing([(p[: 120 - gap], not gap)], 1.0)


def test_regions_of_a_page():
    r = gate.validate(circle(), PAGE)
    assert r.enclosed_regions == 1 and r.leaking_regions == 0 and r.dangling_endpoints == 0
    assert r.min_region_area_mm2 == pytest.approx(np.pi * 16**2, rel=0.15)
    r = gate.validate(circle(8), PAGE)
    assert r.enclosed_regions == 0 and r.leaking_regions > 0 and r.dangling_endpoints == 2 and not r.passed


def test_two_rectangles():
    box = lambda x0, x1: (np.array([(x0, 0.2), (x1, 0.2), (x1, 0.8), (x0, 0.8)], np.float32), True)
    for second in (0.6, 0.4):
        r = gate.validate(styles.Drawing([box(0.1, 0.4), box(second, 0.9)], 1.0), PAGE)
        assert r.enclosed_regions == 2


def test_measures_that_do_not_apply_do_not_count():
    r = gate.Report(0.05, 3, None, None, None, None, 0.1)
    assert r.passed and not gate.Report(0.05, 3, None, None, None, None, 0.04).passed
    assert gate.Report(0.05, 3, 1, None, None, 0, None, {"leaking": 1}).passed


def test_bad_pages():
    for bad in ({"size": "B0"}, {"margin_mm": 120.0}, {"dpi": 0}, {"size": (0.0, 5.0)}):
        with pytest.raises(gate.BadPage):
            gate.Page(**bad)
    assert gate.Page(orientation="landscape").mm == (297.0, 210.0)


def test_files():
    svg = gate.to_svg(circle(), gate.Page())
    assert svg.count("<path") == 1 and " Z" in svg and 'width="210mm"' in svg
    assert gate.to_pdf(circle(), gate.Page()).startswith(b"%PDF") and b" s" in gate.to_pdf(circle(), gate.Page())
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = k.png(a)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert raw == b"".join(b"\0" + row.tobytes() for row in a)


def net(rgb):
    return 255 - 200 * (k.to_gray(rgb[..., ::-1]).astype(int) % 64 < 12).astype(np.uint8)


def test_styles():
    y, x = np.mgrid[0:48, 0:64]
    masks = lambda image: [(np.hypot(y - 32, x - 46) < 10, 300.0), (np.ones((48, 64)), 3072.0)]
    for name, style in styles.STYLES.items():
        extras = {"model": net} if name in ("anime2sketch", "informative_drawings", "gated", "lineart", "lineart-raster") else {}
        if extras:
            with pytest.raises(styles.ModelMissing):
                style(photo())
        if name == "lineart":
            extras |= {"masks": masks, "dpi": 30.0}
        art = style(photo(), **extras)
        if isinstance(art, styles.Raster):
            assert art.image.shape == (48, 64)
            continue
        assert art.aspect == 64 / 48
        for p, _ in art.paths:
            assert len(p) >= 2 and p.min() >= 0 and p.max() <= 1
        if not extras:
            assert 0.005 <= (k.rasterize(art.paths, art.aspect, 64) < 128).mean() <= 0.4
    with pytest.raises(KeyError):
        styles.get("none")


def test_smallest_mask():
    big, small = np.ones((4, 4), bool), np.zeros((4, 4), bool)
    small[1:3, 1:3] = True
    labels = styles.smallest_mask_labels((4, 4), [(small, 4.0), (big, 16.0)])
    assert labels[1, 1] != labels[0, 0] and len(np.unique(labels)) == 2
    half = np.zeros((4, 4), bool)
    half[:, :1] = True
    assert (styles.smallest_mask_labels((4, 4), [(half, 4.0)]) == 0).all()


def test_smoothers_keep_flat_images():
    flat = np.full((20, 20), 90.0)
    for out in (k.gaussian(flat, 2), k.bilateral(flat), k.l0_smooth(flat), k.rolling_guidance(flat, rounds=1)):
        assert np.allclose(out, 90)
    assert np.allclose(k.mean_shift(np.dstack([flat] * 3), 2, 20), 90)
    assert k.downscaled(np.zeros((100, 50, 3), np.uint8), 20).shape == (20, 10, 3)
    assert k.downscaled(np.zeros((10, 5, 3), np.uint8), 20).shape == (10, 5, 3)


def test_contours():
    m = np.zeros((8, 9), bool)
    m[1:4, 1:5] = True
    m[6, 7] = True
    box, dot = k.contours(m)
    assert len(box) == 10 and k.path_length(box, True) == 10 and dot.tolist() == [[7, 6]]
    line = np.zeros((3, 6), bool)
    line[1, 1:5] = True
    (c,) = k.contours(line)
    assert {tuple(p) for p in c.tolist()} == {(x, 1) for x in range(1, 5)}


def test_parts_of_labels():
    a = np.array([[0, 0, 1], [1, 0, 1], [1, 1, 0]])
    assert sorted(k.spatial_regions(a)) == [(0, 1), (0, 3), (1, 2), (1, 3)]


def test_skeleton_counts():
    m = np.zeros((40, 40), bool)
    m[20, 5:35] = m[5:35, 20] = True
    counts = k.skeleton_counts(m)
    assert counts["endpoints"] == 4 and counts["hubs"] == 1 and counts["lines"] == 1


@pytest.mark.parametrize("method", ["area", "linear", "cubic", "lanczos"])
def test_resizing_keeps_flat_images_and_ramps(method):
    assert np.allclose(k.resize(np.full((12, 9), 7.0), 20, 5, method), 7)
    ramp = np.tile(np.arange(40.0), (3, 1))
    up = k.resize(ramp, 3, 80, method)[0, 20:60]
    assert np.abs(up - ((np.arange(20, 60) + 0.5) / 2 - 0.5)).max() < (0.5 if method == "area" else 0.02)
    assert k.resize(np.arange(6).reshape(1, 6), 1, 3, "nearest").tolist() == [[0, 2, 4]]


def test_meaningful_chains():
    rng = np.random.default_rng(8)
    m = rng.random((60, 60)) * 10
    m[30, 5:55] = 100
    strong, weak = np.c_[np.arange(5, 55), np.full(50, 30)], np.c_[np.arange(5, 55), np.full(50, 10)]
    assert [c[0, 1] for c in styles.meaningful([strong, weak], m)] == [30]


def test_seeds_follow_an_edge_and_stay_whole():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:60, 0:80]
    disc = (y - 31) ** 2 + (x - 37) ** 2 < 19**2
    image = np.where(disc[..., None], [30, 60, 200], [220, 180, 40]) + rng.integers(-8, 9, (60, 80, 3))
    labels = k.seeds(image.astype(np.uint8), 48)
    n = len(np.unique(labels))
    assert n == labels.max() + 1 and 24 <= n <= 80  # none has vanished
    inside = np.bincount(labels.ravel(), disc.ravel().astype(float))
    size = np.bincount(labels.ravel())
    assert np.minimum(inside, size - inside).sum() < 0.01 * labels.size  # the grid alone errs on 4.6 %
    assert all(k.components(labels == i, 4)[1] == 1 for i in range(n))
    assert np.array_equal(labels, k.seeds(image.astype(np.uint8), 48))


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 3), (40, 40)])
def test_seeds_of_flat_and_tiny_images_keep_the_grid(shape):
    labels = k.seeds(np.full((*shape, 3), 90, np.uint8), 9)
    assert labels.shape == shape and labels.min() == 0


def test_region_takes_superpixels():
    image = np.full((60, 60, 3), 240, np.uint8)
    image[15:45, 15:45] = (20, 90, 30)
    for how in ("seeds", "slic"):
        assert styles.region(image, segmentation=how, detection="labels", superpixels=36).paths
    with pytest.raises(ValueError):
        styles.region(image, segmentation="other")


def test_a_narrow_image_meets_a_network_in_strips(monkeypatch):
    """A long, narrow image has its shorter side at the network's resolution; the network never sees all of that at once."""
    monkeypatch.setattr(styles, "STRIP_PIXELS", 20_000, raising=False)
    seen = []

    def model(rgb):
        seen.append(rgb.shape[0] * rgb.shape[1])
        return 255 - k.to_gray(rgb[..., ::-1])

    for shape in ((300, 7), (7, 300)):
        image = np.random.default_rng(3).integers(0, 256, (*shape, 3), dtype=np.uint8)
        grown = np.clip(np.rint(k.resize(image[..., ::-1], *styles.by_short_side(*shape, 128)[:2])), 0, 255).astype(np.uint8)
        want = np.clip(np.rint(k.resize(model(grown).astype(float), *shape)), 0, 255).astype(int)
        seen.clear()
        got = styles._response(image, model, 128)
        assert got.shape == shape and np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01
        assert max(seen) < 40_000 < grown.shape[0] * grown.shape[1]


def test_a_raster_of_a_narrow_image_is_made_in_strips(monkeypatch):
    monkeypatch.setattr(styles, "STRIP_PIXELS", 20_000, raising=False)
    image = np.random.default_rng(4).integers(0, 256, (300, 7, 3), dtype=np.uint8)
    seen = []
    art = styles.lineart_raster(image, lambda rgb: (seen.append(rgb.size // 3), 255 - k.to_gray(rgb[..., ::-1]))[1], 128)
    assert art.image.shape == (300, 7) and len(seen) > 1 and max(seen) < 40_000


def test_a_strip_is_resized_in_bands(monkeypatch):
    """As floats only a few rows of a strip are there at once, and they are what they are when the strip is resized whole."""
    monkeypatch.setattr(styles, "STRIP_PIXELS", 100_000)
    image = np.random.default_rng(5).integers(0, 256, (900, 7, 3), dtype=np.uint8)
    most, resize = [], k.resize
    monkeypatch.setattr(k, "resize", lambda a, *x: (most.append(out.size) if (out := resize(a, *x)).ndim == 3 else None, out)[1])
    art = styles.lineart_raster(image, lambda rgb: 255 - k.to_gray(rgb[..., ::-1]), 128)
    assert 0 < max(most) <= 64 * 128 * 3
    monkeypatch.setattr(styles, "BAND_ROWS", 1_000_000)
    assert np.array_equal(art.image, styles.lineart_raster(image, lambda rgb: 255 - k.to_gray(rgb[..., ::-1]), 128).image)


def test_color_images_are_packed_row_by_row(spark, sf_dir):
    """No aggregate holds an image's pixels one by one, and the bytes are those of the pixels in order."""
    from linework.plans import kernel_queries
    from linework.sources.derived import color_raster

    images = kernel_queries._color_images(spark, sf_dir)
    plan = images._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(x, x" in plan  # an image row's, and then an image's rows
    want = {}
    for r in sorted(color_raster(spark, sf_dir).collect(), key=lambda r: (r.y, r.x)):
        want.setdefault(str(r.image_id), bytearray()).extend((r.b, r.g, r.r))
    got = {r.image_id: r for r in images.collect()}
    assert {i: bytes(r["data"]) for i, r in got.items()} == {i: bytes(b) for i, b in want.items()}
    assert all(r.height * r.width * 3 == len(r["data"]) for r in got.values())

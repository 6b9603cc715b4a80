"""Images in, line art out: sources, conversion, batches, profiles, the command line, and relational operators on odd input."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework import cli, streaming
from linework.operators import gate, raster, report, vector
from linework.operators import kernels as k
from linework.plans import engine
from linework.sources import images
from tests.test_kernels import net, photo

PAGE = gate.Page(size=(60.0, 60.0), margin_mm=5, dpi=80)


def color_png(a):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + a[y, :, ::-1].tobytes() for y in range(a.shape[0]))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.png").write_bytes(color_png(photo()))
    (d / "b.PNG").write_bytes(k.png(k.to_gray(photo())))
    (d / "bad.png").write_text("not an image")
    (d / "note.txt").write_text("ignored")
    return str(d)


def test_files_to_line_art(spark, folder, tmp_path):
    read = images.read_images(spark, folder)
    rows = {os.path.basename(r.image_id): r for r in read.collect()}
    assert rows["bad.png"].error_class == "unsupported_image" and len(rows) == 3
    a = engine.decode(bytes(rows["a.png"].data), 48, 64, rows["a.png"].n_channels)
    assert (a == photo()).all()
    assert engine.decode(bytes(rows["b.PNG"].data), 48, 64, rows["b.PNG"].n_channels).shape == (48, 64, 3)
    done = engine.convert(read, engine.Profile(page=PAGE, style="canny", detail="adult"))
    summary = report.batch_summary(engine.status(done, strict=True)).first()
    assert (summary.total, summary.succeeded, summary.failed) == (3, 2, 1)
    out = str(tmp_path / "out")
    for form in ("svg", "pdf", "png"):
        assert engine.save(engine.rendered(done, PAGE, form), out, form) == 2
    assert len(os.listdir(out)) == 6
    with pytest.raises(ValueError):
        engine.rendered(done, PAGE, "gif")
    p = engine.points(done)
    assert vector.path_length(p).count() == engine.paths(done).count() > 0


def test_errors_stay_with_their_rows(spark):
    df = images.from_arrays(spark, {"a": photo(), "big": np.zeros((90, 90), np.uint8)})
    done = {r.image_id: r for r in engine.convert(df, engine.Profile(page=PAGE, style="xdog", max_pixels=4000)).collect()}
    assert done["a"].error_class is None and done["a"].timings and done["big"].error_class == "image_too_large"
    lacking = engine.convert(df, engine.Profile(page=PAGE, style="gated")).collect()
    assert {r.error_class for r in lacking} == {"ModelMissing"}
    given = engine.convert(df.where("image_id = 'a'"), engine.Profile(page=PAGE), lambda: {"model": net}).first()
    assert given.raster is not None and given.raster_width == 64 and given.dangling_endpoints is None
    with pytest.raises(KeyError):
        engine.convert(df, engine.Profile(style="none"))
    with pytest.raises(ValueError):
        images.from_arrays(spark, {"x": np.zeros((2, 2), float)})
    assert engine.convert(df.where("false"), engine.Profile(style="canny")).count() == 0


def test_profiles():
    p = engine.Profile(page=gate.Page(size=(100.0, 80.0)), style="canny", detail="adult")
    assert engine.Profile.from_json(p.to_json()) == p
    assert engine.Profile.from_json('{"style": "xdog"}').detail == "child"
    for bad in ('{"page": {"size": "A4"}}', '{"colour": 1}', "[]", '{"detail": "huge"}'):
        with pytest.raises(ValueError):
            engine.Profile.from_json(bad)


def test_detail_levels_drop_more_for_the_young():
    art = engine.styles.canny(photo())
    counts = [len(engine.apply_detail(art, engine.Profile(page=gate.Page(size=(30.0, 30.0), margin_mm=2), detail=d)).paths) for d in ("toddler", "child", "adult")]
    assert counts == sorted(counts)


def test_command_line(folder, tmp_path, spark):
    out = str(tmp_path / "o.svg")
    page = ["--page-size", "A5", "--dpi", "40"]
    assert cli.main([folder + "/a.png", out, "--style", "canny", "--detail", "adult", *page]) == cli.OK and os.path.exists(out)
    assert cli.main([folder, str(tmp_path / "batch"), "--style", "xdog", "--format", "png", *page]) == cli.FAILED
    assert sorted(os.listdir(tmp_path / "batch")) == ["a.png", "b.png"]
    assert cli.main([folder + "/none.png", out]) == cli.NOT_FOUND
    assert cli.main([folder + "/note.txt", out]) == cli.UNSUPPORTED
    assert cli.main([folder + "/bad.png", out, "--style", "canny"]) == cli.UNSUPPORTED
    assert cli.main([folder + "/a.png", out, "--page-size", "B9"]) == cli.BAD_ARGUMENTS
    assert cli.main([folder + "/a.png", out]) == cli.NO_MODEL
    assert cli.main([folder + "/a.png", str(tmp_path / "s.svg"), "--style", "canny", "--max-pixels", "10", *page]) == cli.TOO_LARGE
    bad = tmp_path / "p.json"
    bad.write_text(json.dumps({"detail": "none"}))
    assert cli.main([folder + "/a.png", out, "--profile", str(bad)]) == cli.BAD_ARGUMENTS
    assert cli.main([folder + "/a.png", str(tmp_path / "t.svg"), "--style", "canny", "--strict", "--dpi", "40"]) == cli.STRICT and not os.path.exists(tmp_path / "t.svg")


def test_exit_codes_and_flags(folder, tmp_path, spark, capsys):
    assert (cli.UNSUPPORTED, cli.TOO_LARGE, cli.NO_MODEL, cli.BAD_CHECKSUM, cli.UNAVAILABLE, cli.STRICT) == (2, 3, 4, 5, 6, 7)
    page, out = ["--page-size", "A5", "--dpi", "40", "--style", "canny"], str(tmp_path / "d.svg")
    assert cli.main([folder + "/a.png", out, *page, "--device", "cpu", "--jobs", "2", "--thickness", "3", "--verbose", "--debug-dir", str(tmp_path / "debug")]) == cli.OK
    assert os.path.isdir(tmp_path / "debug" / "a")
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    assert "canny" not in capsys.readouterr().out.split("--show-experimental")[1].split("--detail")[0]


def test_profiles_of_all_fields():
    p = engine.Profile(style="canny", device="cuda", debug_dir="x")
    assert engine.Profile.from_json(p.to_json()) == p
    assert engine.Profile.from_json('{"device": "cpu", "debug_dir": null, "seed": null}').device == "cpu"
    with pytest.raises(ValueError):
        engine.Profile.from_json('{"device": "none"}')


def test_no_row_is_lost(spark):
    rows = [("a", None, None, None, None, None), ("b", 4, 4, None, bytearray(16), None), ("c", 3, 3, 1, None, None), ("d", 0, 4, 1, bytearray(), None), ("e", 2, 2, 1, bytearray(4), "unsupported_image"), ("f", 9000, 9000, 1, bytearray(4), None)]
    df = spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary, error_class string")
    got = {r.image_id: r.error_class for r in engine.convert(df, engine.Profile(page=PAGE, style="canny")).collect()}
    assert got == dict.fromkeys("abcde", "unsupported_image") | {"f": "image_too_large"}


def test_seeds_by_image():
    assert engine.seed_of(0, "a") != engine.seed_of(0, "b") and engine.seed_of(0, "a") == engine.seed_of(0, "a") != engine.seed_of(1, "a") and engine.seed_of(5, "") == 5


def test_two_small_regions_that_choose_each_other(spark):
    """Labels 1 and 2 are nearest to each other: both take 1, then the large neighbour."""
    rows = [("i", 0, x, v, label) for x, (v, label) in enumerate([(0, 0)] * 6 + [(100, 1), (110, 2)] + [(250, 3)] * 6)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, v int, label int")
    assert {r.label for r in raster.merge_small_regions(df, "v", 2).collect()} == {0, 1, 3}
    assert {r.label for r in raster.merge_small_regions(df, "v", 3).collect()} == {0, 3}


def test_a_line_that_passes_beside_an_end(spark):
    """The long segment has no vertex near the end."""
    rows = [("i", 1, 0, 5.0, 5.0, False), ("i", 1, 1, 5.0, 9.0, False), ("i", 2, 0, 0.0, 4.6, False), ("i", 2, 1, 10.0, 4.6, False)]
    df = spark.createDataFrame([(*r, "detail") for r in rows], "image_id string, path_id int, i int, x double, y double, closed boolean, kind string")
    assert {(r.path_id, r.i) for r in vector.isolated_endpoints(df, 1.0).collect()} == {(1, 1), (2, 0), (2, 1)}


def test_sizes_that_networks_see():
    assert engine.styles.by_short_side(300, 500, 512) == (512, 832, 512, 832)
    assert engine.styles.by_long_side(300, 500, 512) == (512, 512, 307, 512)
    seen = []
    engine.styles.anime2sketch(photo(), lambda rgb: (seen.append(rgb.shape), rgb[..., 0])[1])
    assert seen[0][0] % 256 == 0 and seen[0][1] % 256 == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "frames")
    images.from_arrays(spark, {"a": photo(), "b": photo()}).write.parquet(source)
    rows = streaming.converted(streaming.frames(spark, source), engine.Profile(page=PAGE, style="canny"))
    q = rows.select("image_id", "passed").writeStream.format("memory").queryName("art").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("art").count() == 2


def pixels(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, int(y), int(x), int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id int, y int, x int, v int")


def test_relational_stencils_equal_the_array_kernels(spark):
    a = np.random.default_rng(4).integers(0, 256, (12, 9)).astype(np.uint8)
    df = pixels(spark, a)
    gx, gy = k.sobel(a)
    for r in raster.sobel(df).collect():
        assert (r.gx, r.gy) == (gx[r.y, r.x], gy[r.y, r.x])
    counts = k.neighbor_counts(a < 100)
    for r in raster.neighbor_counts(df.withColumn("v", (F.col("v") < 100).cast("int"))).collect():
        assert r.n == counts[r.y, r.x]
    want = k.normalize(a)
    assert all(r.v == want[r.y, r.x] for r in raster.stretched(df).collect())
    assert {r.v for r in raster.stretched(df.withColumn("v", F.lit(100))).collect()} == {255}
    assert images.to_pixels(images.from_pixels(df)).select("y", "x", "v").exceptAll(df.select("y", "x", "v")).count() == 0


def test_gate_columns(spark):
    rows = [(0.05, None, None, None, None, True), (0.05, 1, None, None, None, False), (0.09, None, None, None, None, False), (0.05, 0, 0, 1.0, 0.05, True), (0.05, 0, 0, 0.9, 0.05, False), (None, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "ink_coverage double, leaking_regions int, dangling_endpoints int, min_region_area_mm2 double, antialiased_fraction double, want boolean")
    assert df.withColumn("passed", raster.passed()).where("passed <> want or passed is null").count() == 0


def test_merging_regions_until_none_is_small(spark):
    a = np.zeros((6, 6), int)
    a[2, 2], a[2, 3], a[4:, 4:] = 1, 2, 3
    df = pixels(spark, a * 50).withColumn("label", (F.col("v") / 50).cast("int"))
    out = raster.merge_small_regions(df, "v", 3, 20, cut=lambda d: spark.createDataFrame(d.collect(), d.schema))
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 32, 3: 4}


def test_smallest_mask_ties(spark):
    df = spark.createDataFrame([(1, 5, 9, 0, 0), (1, 6, 9, 0, 0), (1, 7, 20, 0, 0)], "image_id int, mask_id int, area int, y int, x int")
    assert raster.smallest_mask(df).first().mask_id == 6


def lines(spark, rows):
    return spark.createDataFrame([(1, p, i, float(x), float(y), c, kind) for p, c, kind, pts in rows for i, (x, y) in enumerate(pts)], "image_id int, path_id int, i int, x double, y double, closed boolean, kind string")


def test_paths(spark):
    df = lines(spark, [(1, False, "boundary", [(0, 0), (3, 4), (3, 0)]), (2, True, "boundary", [(0, 0), (3, 4), (3, 0)]), (3, False, "detail", [(7, 7)])])
    assert {r.path_id: r.length for r in vector.path_length(df).collect()} == {1: 9.0, 2: 12.0, 3: 0.0}
    assert [r.path_id for r in vector.length_filter(df, 12).select("path_id").distinct().collect()] == [2]
    assert vector.bounds(df.where("false")).count() == 0
    cut = vector.chaikin(lines(spark, [(1, True, "boundary", [(0, 0), (10, 0), (10, 10), (0, 10)])]))
    assert cut.count() == 8
    twice = vector.chaikin(lines(spark, [(1, False, "boundary", [(0, 0), (5, 5), (10, 0)])]), 2).orderBy("i").collect()
    assert (twice[0].x, twice[0].y, twice[-1].x, twice[-1].y) == (0, 0, 10, 0)


def test_collinear_points_as_by_the_kernel(spark):
    rng = np.random.default_rng(6)
    rows = [(n, bool(n % 2), "boundary", rng.integers(0, 3, (rng.integers(1, 9), 2)).tolist()) for n in range(60)]
    got = {}
    for r in vector.collinear_drop(lines(spark, rows)).orderBy("path_id", "i").collect():
        got.setdefault(r.path_id, []).append([r.x, r.y])
    for n, closed, _, pts in rows:
        assert got[n] == k.straightened(np.array(pts), closed).tolist(), (pts, closed)


def test_near_details_go(spark):
    base = [(0.1 * i, 0.5) for i in range(8)]
    df = lines(spark, [(1, False, "boundary", base), (2, False, "detail", [(x, y + 0.004) for x, y in base]), (3, False, "detail", [(x, y + 0.2) for x, y in base])])
    assert {r.path_id for r in vector.hausdorff_dedup(df, 0.01).collect()} == {1, 3}
    assert {r.path_id for r in vector.hausdorff_dedup(df, 0.004 - 1e-9).collect()} == {1, 2, 3}


def test_isolated_ends(spark):
    df = lines(spark, [(1, False, "boundary", [(0.5, 0.5), (10.5, 0.5)]), (2, False, "boundary", [(10.5, 1.5), (30.5, 1.5)]), (3, True, "boundary", [(50, 50), (60, 60), (50, 60)])])
    assert {(r.path_id, r.i) for r in vector.isolated_endpoints(df, 1.0).collect()} == {(1, 0), (2, 1)}


def test_comparison(spark):
    from linework.plans import compare

    df = images.from_arrays(spark, {"a": photo(), "b": photo()[::-1].copy()})
    reference = images.from_arrays(spark, {"a": k.rasterize(engine.styles.canny(photo()).paths, 64 / 48, 64)})
    rows = {(r.image_id, r.style): r for r in compare.compare(df, ["canny", "gated"], references=reference).collect()}
    assert len(rows) == 4 and rows["a", "gated"].error_class == "ModelMissing"
    assert rows["a", "canny"].ref_f1 > 0.9 and rows["b", "canny"].ref_f1 is None and rows["b", "canny"].component_count > 0
    table = compare.ablation(df, {"fine": ("canny", {}), "coarse": ("canny", {"low": 200.0, "high": 400.0})})
    assert table.count() == 4 and report.markdown(table.drop("seconds").orderBy("image_id", "variant")).count("\n") == 5
    with pytest.raises(ValueError):
        report.markdown(table, 2)
    seen = compare.stages(df, engine.Profile(page=PAGE, style="canny")).collect()
    assert [r.stage for r in seen if r.image_id == "a"] == ["denoised", "edges"] and seen[0].png.startswith(b"\x89PNG")


def test_csv_has_blanks(spark, tmp_path):
    report.write_csv(spark.createDataFrame([("a", None), ("b", 0.5)], "image string, ref_f1 double"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).where("ref_f1 is null").count() == 1


def test_segments():
    from linework.plans import compare

    y, x = np.mgrid[0:40, 0:40]
    masks = lambda image: [((y // 8 == a) & (x // 8 == b), 64.0) for a in range(5) for b in range(5)] + [((y == 0) & (x == 0), 1.0)]
    assert compare.evaluate_segments(np.zeros((40, 40, 3), np.uint8), masks, 4)["region_count"] == 25


def test_weights(tmp_path, monkeypatch):
    import hashlib

    from linework.sources import weights

    f = tmp_path / "w"
    f.write_bytes(b"x")
    assert weights.resolve(str(f), "NO_SUCH") == str(f)
    monkeypatch.setenv("SOME_WEIGHTS", str(f))
    assert weights.verify(weights.resolve(None, "SOME_WEIGHTS"), hashlib.sha256(b"x").hexdigest()) == str(f)
    with pytest.raises(weights.WeightsMissing):
        weights.resolve(None, "NO_SUCH")
    with pytest.raises(weights.ChecksumError):
        weights.verify(str(f), "0" * 64)

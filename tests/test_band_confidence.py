"""Zones hold all pixels of their band."""

import pytest

from linework.plans import kernel_queries


def test_pixels_off_every_fifth_column_count(spark, monkeypatch):
    rows = [(1, y, x, 0 if x % 5 else 255) for y in range(16) for x in range(10)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    monkeypatch.setattr(kernel_queries, "raster", lambda spark, d: pixels)
    got = {r.path_id: r.confidence for r in kernel_queries.band_confidence(spark, "").collect()}
    assert got == {0: pytest.approx(204), 1: pytest.approx(204)}

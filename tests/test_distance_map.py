"""Distances of every pixel, far ones and those of images without ink too."""

import numpy as np

from linework.plans import kernel_queries


def test_every_pixel_has_its_distance(spark, monkeypatch):
    a = np.full((3, 5, 40), 255, np.uint8)
    a[0, 2, 3] = a[0, 4, 30] = a[1, 0, 0] = 10  # the third has no ink
    images = spark.createDataFrame([(str(k), 5, 40, bytearray(x.tobytes())) for k, x in enumerate(a)], "image_id string, height int, width int, data binary")
    monkeypatch.setattr(kernel_queries, "_images", lambda spark, d: images)
    got = {(r.image_id, r.y, r.x): r.distance for r in kernel_queries.distance_map(spark, "").collect()}
    assert len(got) == a.size
    for k, x in enumerate(a):
        ink = np.argwhere(x < 48)
        for y, z in np.ndindex(x.shape):
            want = round(float(np.sqrt(((ink - (y, z)) ** 2).sum(1).min())), 6) if len(ink) else None
            assert got[str(k), y, z] == want
    assert max(v for v in got.values() if v is not None) > 5

"""Copies of images: what a search returns, recall, and classes."""

import numpy as np

from linework.llm import media

RNG = np.random.default_rng(11)
BASE = RNG.normal(size=(4, 64))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, np.asarray(v).tolist()) for i, v in rows], "vec_id long, embedding array<double>")


def test_every_class_and_member_is_listed(spark):
    queries = vectors_of(spark, [(100, BASE[0]), (200, BASE[1])])
    pairs = spark.createDataFrame([(100, 3, 3, 5, 0.0, 1.0), (100, 40, 42, 9, 0.0, 1.0), (100, 60, 60, 4, 0.0, 1.0)], "query_id long, image_id long, holder long, n_agreeing long, turn double, scale double")
    members = spark.createDataFrame([(3, 3), (4, 3), (40, 40), (41, 40), (42, 40)], "image_id long, class_id long")
    got = media.listed(queries, pairs, members).collect()
    asked = {(r.query_id, r.class_id, r.image_id, r.n_agreeing) for r in got if r.kind == "query"}
    assert asked == {(100, 3, 3, 5), (100, 40, 42, 9), (100, 60, 60, 4), (200, None, None, None)}
    assert {(r.image_id, r.class_id) for r in got if r.kind == "member"} == {(3, 3), (4, 3), (40, 40), (41, 40), (42, 40)}
    assert len(got) == 9


def test_op7_names_all_copies(spark, tmp_path):
    rows = [(100, BASE[0]), (11, BASE[0]), (205, BASE[0]), (200, BASE[1]), (7, BASE[2])]
    vectors_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = media.op7(spark, str(tmp_path)).collect()
    assert {(r.query_id, r.class_id) for r in got if r.kind == "query"} == {(100, 11), (200, 200)}
    assert {(r.image_id, r.class_id) for r in got if r.kind == "member"} == {(11, 11), (100, 11), (205, 11)}


def hidden(a):
    """All but the lower right quarter of a raster is cut off, and a patch covers a corner of the rest."""
    c = a[24:, 20:].copy()
    c[-10:, -10:] = 128
    return c


def test_large_crops_are_found():
    """Votes of all corners of a crop and an image; with the eight strongest of the image too few are left."""
    found, strongest = 0, 0
    e = np.random.default_rng(5).normal(size=(40, 64)).astype(np.float32)
    for a in media.render(e):
        q = media.describe(hidden(a)[None])[5].view(np.uint64)
        for most in (media.INDEXED, 8):
            d = media.describe(a[None], most)[5].view(np.uint64)
            n = int((np.bitwise_count(q[:, None] ^ d[None]).sum(2) <= media.MOST_APART).any(1).sum())
            found, strongest = found + (most != 8 and n >= media.LEAST_AGREEING), strongest + (most == 8 and n >= media.LEAST_AGREEING)
    assert found >= 36 > strongest


def test_a_query_meets_members_that_the_first_of_their_class_hides(spark, tmp_path):
    """From 1 to 300 each is near the next, but 1 and the query made of 300 share too few corners."""
    a, b = BASE[3], RNG.normal(size=64)
    mixed = lambda t: a * (1 - t) + b * t
    rows = [(i, mixed(t)) for i, t in ((1, 0.0), (2, 0.06), (3, 0.12), (4, 0.18), (5, 0.24), (300, 0.30), (8, 0.30))]
    vectors_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = media.op7(spark, str(tmp_path)).collect()
    members = {r.image_id: (r.set_id, r.class_id) for r in got if r.kind == "member"}
    assert members == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 1), 8: (8, 1), 300: (8, 1)}
    found = [r.class_id for r in got if r.kind == "query" and r.query_id == 300]
    assert found == [1]
    vectors = vectors_of(spark, rows)
    pairs = media.copies(media.cut(media.corners(media.rendered(vectors.where("vec_id = 300"), True)), "q"), media.cut(media.corners(media.rendered(vectors)), "d"))
    images = {r.image_id for r in pairs.collect()}
    assert 8 in images and 1 not in images
    assert {r.class_id for r in got if r.kind == "query"} == {1}


def corner(image, k, word, y=20.0):
    return (image, y, 10.0 + 3 * k, 1.0, 0.0, word, word, word, word)


def test_all_links_to_leaders_count(spark):
    """10 agrees with 1 and with 2, which do not agree: all three are one class."""
    rows = [corner(1, k, 1000 + k) for k in range(4)] + [corner(2, k, 2000 + 7 * k) for k in range(4)]
    rows += [corner(10, k, 1000 + k) for k in range(4)] + [corner(10, k, 2000 + 7 * k, 40.0) for k in range(4)]
    found = spark.createDataFrame(rows, media.CORNER)
    assert {tuple(r) for r in media.classes(found).collect()} == {(1, 1), (2, 1), (10, 1)}
    assert {tuple(r) for r in media.sets(found).collect()} == set()


def brute_pairs(q, d, most_apart=media.MOST_APART, least=media.LEAST_AGREEING):
    """(query, image) by comparing every descriptor of q with every one of d, with the votes of _agreeing() in plain loops."""
    out = set()
    (qi, qy, qx, qs, qa, qw), (di, dy, dx, ds, da, dw) = q, d
    for i in np.unique(qi):
        for j in np.unique(di):
            a, b = np.flatnonzero(qi == i), np.flatnonzero(di == j)
            near = np.bitwise_count(qw[a][:, None].view(np.uint64) ^ dw[b][None].view(np.uint64)).sum(2) <= most_apart
            votes = {}
            for u, v in zip(*np.nonzero(near), strict=True):
                u, v = a[u], b[v]
                turn, zoom = da[v] - qa[u], qs[u] / ds[v]
                ty = dy[v] - zoom * (qy[u] * np.cos(turn) + qx[u] * np.sin(turn))
                tx = dx[v] - zoom * (qx[u] * np.cos(turn) - qy[u] * np.sin(turn))
                place, size = int(np.floor(turn % (2 * np.pi) * 12 / (2 * np.pi) + 0.5)) % 12, round(np.log(zoom) * 4)
                for s in (0, 0.5):
                    for t in (0, 0.5):
                        votes.setdefault((place, size, s, t, np.floor(ty / media.SHIFT_BIN + s), np.floor(tx / media.SHIFT_BIN + t)), set()).add(u)
            if any(len(x) >= least for x in votes.values()):
                out.add((int(i), int(j)))
    return out


def test_search_and_classes_against_all_pairs(spark, tmp_path):
    """Families of edited copies among strangers: recall of pairs, and of images' classes, against comparing every descriptor."""
    rng = np.random.default_rng(7)
    rows = []
    for family in range(12):
        e = rng.normal(size=64)
        rows += [(family * 100 + k, e + rng.normal(size=64) * (0.0, 0.01, 0.03, 0.06)[k % 4]) for k in range(6)]
    rows += [(5000 + k, rng.normal(size=64)) for k in range(60)]
    vectors = vectors_of(spark, rows)
    queries = vectors.where("vec_id % 100 = 0")
    asked, every = (media.corners(media.rendered(v, alter)) for v, alter in ((queries, True), (vectors, False)))
    as_arrays = lambda df: (lambda t: (t.image_id.to_numpy(), t.y.to_numpy(), t.x.to_numpy(), t.scale.to_numpy(), t.angle.to_numpy(), t[["d0", "d1", "d2", "d3"]].to_numpy()))(df.toPandas())
    q, d = as_arrays(asked), as_arrays(every)
    want = brute_pairs(q, d)
    got = {(r.query_id, r.image_id) for r in media.copies(media.cut(asked, "q"), media.cut(every, "d")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50
    assert all(i // 100 == j // 100 for i, j in want)
    links = {p for p in brute_pairs(d, d) if p[0] < p[1]}
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = media.op7(spark, str(tmp_path)).collect()
    of = {r.image_id: r.class_id for r in out if r.kind == "member"}
    alike = sum(of.get(i, i) == r for i, r in root.items())
    assert alike >= 0.98 * len(root)
    classes = {(i, root[j]) for i, j in want}
    assert len({(r.query_id, r.class_id) for r in out if r.kind == "query" and r.class_id is not None} & classes) >= 0.98 * len(classes)


def test_hot_chunks_are_dealt_to_several_tasks(spark, monkeypatch):
    """A join with a key of very many rows gives the rows of a plain one."""
    monkeypatch.setattr(media, "HOT_LEAST", 8)
    many = media.cut(spark.range(400).selectExpr("cast(if(id < 300, 0, id % 7) as int) chunk", "id % 3 value", "id image_id"), "many")
    few = spark.createDataFrame([(c, v, f"{c}{v}") for c in range(7) for v in range(3)], "chunk int, value long, name string")
    plain = few.join(many, ["chunk", "value"])
    got = media._spread(few, many, ["chunk", "value"], ["image_id"])
    assert sorted(map(tuple, got.select("chunk", "value", "name", "image_id").collect())) == sorted(map(tuple, plain.select("chunk", "value", "name", "image_id").collect()))


def test_a_class_of_many_near_copies_has_few_entries(spark):
    """Entries in the tables grow far less than the class, and the query still finds it."""
    rng = np.random.default_rng(9)
    e = rng.normal(size=64)
    vectors = vectors_of(spark, [(i, e + rng.normal(size=64) * 0.004) for i in range(1, 201)])
    found = media.cut(media.corners(media.rendered(vectors)), "d")
    members = media.cut(media.classes(found), "m")
    assert members.count() == 200 and members.select("class_id").distinct().count() == 1
    asked = media.cut(media.corners(media.rendered(vectors.where("vec_id = 100"), True)), "q")
    few, many = media._one_for_all(found, members).count(), found.count() * media.CHUNKS
    assert few < many / 8
    got = media.copies(asked, found, members).collect()
    assert [r.image_id for r in got] == [1] and got[0].n_agreeing >= media.LEAST_AGREEING


def test_windows_of_words(spark):
    """Chunk values made by Spark's rule and by numpy's are CHUNK_BITS of the descriptor from STARTS[c] on, round the end."""
    words = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, (20, 4))
    bits = np.unpackbits(words.view(np.uint8).reshape(20, 32), axis=1, bitorder="little")
    for c in range(media.CHUNKS):
        own = bits[:, np.arange(media.STARTS[c], media.STARTS[c] + media.CHUNK_BITS) % 256]
        assert (media._values(words)[:, c] == (own * (np.uint64(1) << np.arange(media.CHUNK_BITS, dtype=np.uint64))).sum(1)).all()
    made = media._chunks(spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "image_id long, d0 long, d1 long, d2 long, d3 long")).collect()
    assert len(made) == 20 * media.CHUNKS and all(media._values(words)[r.image_id, r.chunk] == r.value for r in made)

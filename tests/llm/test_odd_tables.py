"""Every query over tables with nulls, repeated rows and clashing columns, and over empty tables."""

import pytest

from linework.llm import queries as q

from .conftest import CLASH, LONG

EXTRA = (1, 2, "t", 3, 4, 5, 1, 6, 0, 0.5)


def write(spark, folder, keep):
    docs = [(None, None), (None, "text without an id"), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (5, LONG), (6, "password=hunter22 " * 3), *((10 + i, f"some words {i} of a text that goes on, and on {i % 7}. " * 4) for i in range(40))]
    spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in docs if keep], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").write.parquet(f"{folder}/documents.parquet")
    labels = [(None, 1, 0), (1, None, None), (3, 1, 0), (3, 0, 1), (999, 0, 1), *((10 + i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40))]
    spark.createDataFrame([(*x, 1) for x in labels if keep], "doc_id long, quality int, toxic int, y int").write.parquet(f"{folder}/labels.parquet")
    pages = [(None, None, None), (1, "http://a/", None), (1, "http://a/", None), (2, "u", "z" * 300), (3, None, "z" * 300), (None, "v", "z" * 300)]
    spark.createDataFrame([(*x, "d", 1) for x in pages if keep], "page_id long, url string, html string, digest string, first long").write.parquet(f"{folder}/pages.parquet")
    turns = [(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "</s>"), (2, 1, None, "y")]
    spark.createDataFrame([(*x, 1) for x in turns if keep], "conv_id long, turn long, role string, text string, formatted int").write.parquet(f"{folder}/conversations.parquet")
    vectors = [(None, [0.1] * 64, 1), (100, None, None), (200, [], 1), (300, [float(i % 9) for i in range(64)], 2), (300, [float(i % 9) for i in range(64)], 2), (301, [None] * 64, 2)]
    spark.createDataFrame([(*x, 1) for x in vectors if keep], "vec_id long, embedding array<float>, label int, scale int").write.parquet(f"{folder}/embeddings.parquet")
    return {"documents": len(docs), "pages": len(pages), "conversations": 4, "embeddings": 4}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    return folder, write(spark, folder, True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, False)
    return folder


ROWS = {1: "documents", 2: "conversations", 3: "documents", 4: "documents", 5: "documents", 7: "embeddings", 8: "documents", 9: "pages", 10: "documents"}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, odd, empty, name):
    folder, sizes = odd
    n = int(name[2:].split("_")[0])
    got = q.queries()[name](spark, folder).collect()
    if n in ROWS:
        assert len(got) == sizes[ROWS[n]]
    if n == 6:
        assert sum(r.piece == 0 for r in got) == sizes["documents"]
    none = q.queries()[name](spark, empty)
    assert none.count() == (1 if n == 2 else 0)  # op2 plants a conversation
    assert none.schema.names == q.queries()[name](spark, folder).schema.names


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, odd[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0

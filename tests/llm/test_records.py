"""Conversations, archives and media."""

import gzip
import hashlib
import os
import random

import numpy as np
import pytest

from linework.llm import chat_format, media, warc

RNG = random.Random(9)


def test_every_turn_is_read_back():
    bits = [*chat_format.MARKS, "\\", "\\\\", " ", "a", "<", "[", "/s>", "\n", "", "é"]
    for _ in range(5000):
        turns = [(RNG.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "a\\"]), "".join(RNG.choice(bits) for _ in range(RNG.randint(0, 6)))) for _ in range(3)]
        assert chat_format.parse(chat_format.format_conversation(turns)) == turns


def test_plain_text_is_not_escaped():
    assert chat_format.format_turn("user", "a \\ b [x] <y>")[1] == 0
    assert chat_format.format_turn("assistant", "</s>")[1] == 1


def test_text_under_the_loss_mask():
    """Cut out of the whole conversation's rendering by the spans of its turns, unescaped, it is what the assistants said."""
    bits = [*chat_format.MARKS, "\\", "\\\\", " ", "a", "[", "/s>", "é"]
    for _ in range(2000):
        turns = [(RNG.choice(["user", "assistant", "tool"]), "".join(RNG.choice(bits) for _ in range(RNG.randint(0, 6)))) for _ in range(4)]
        whole, at, said = chat_format.format_conversation(turns), len(chat_format.START), []
        for role, text in turns:
            out, level = chat_format.format_turn(role, text)
            start, length = chat_format.loss_span(role, out)
            assert whole[at : at + len(out)] == out
            cut = whole[at + start : at + start + length]
            said.append(chat_format.unescape(cut) if level else cut)
            at += len(out)
        assert at == len(whole) and "".join(said) == "".join(t for r, t in turns if r == "assistant")
        assert chat_format.parse(whole) == turns


def test_a_very_long_turn(spark):
    long = "</s> word " * 200_000
    got = chat_format.digests(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")).first()
    assert got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "yo</s>"), (2, None, None, "\\"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 5, "system", "")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, text string, formatted int, escaped string")
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    for conv in (1, 2, None):
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        turns = [(r, x) for _, r, x in own]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.formatted_chars == len(chat_format.format_conversation(turns))
    assert chat_format.digests(df.where("false")).count() == 0
    out = chat_format.formatted(df).where("role = 'assistant' and conv_id = 1").collect()
    assert {r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in out} == {"", "yo\\</s>"}


def test_loser_tree_merges_as_sorting_does():
    for k in range(10):
        for _ in range(60):
            runs = [sorted(RNG.choices(range(15), k=RNG.randint(0, 7))) for _ in range(k)]
            assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_pieces_merge_in_a_stream():
    """Of runs cut into pieces that come by their first keys; no more pieces are held than there are runs."""
    for _ in range(80):
        runs = [sorted((RNG.randrange(200),) for _ in range(RNG.randint(0, 60))) for _ in range(RNG.randint(1, 9))]
        pieces = sorted((run[at], [(x, k) for x in run[at : at + 7]]) for k, run in enumerate(runs) for at in range(0, len(run), 7))
        tree = warc.LoserTree()
        got = list(warc.merged(iter(pieces), tree))
        assert [x for x, _ in got] == sorted(x for run in runs for x in run)
        assert tree.most <= len(runs)


def test_a_range_far_larger_than_a_task_may_hold(spark):
    """One range of all captures: the merge holds a piece of each run, a hundredth of them."""
    rows = [(f"k{RNG.randrange(10**6):06d}", "t", i) for i in range(30_000)]
    runs = [sorted(rows[k::6]) for k in range(6)]
    made = [(*run[at], k, at, [(*c, 1, "d", "response", None) for c in run[at : at + 50]]) for k, run in enumerate(runs) for at in range(0, len(run), 50)]
    pieces = warc.cut(spark.createDataFrame(made, warc.PIECES), "pieces")
    for ranges in (1, 5):
        got = [(r.url_key, r.ts, r.page_id) for r in warc.merge_runs(pieces, ranges).collect()]
        assert got == sorted(rows)
    tree = warc.LoserTree()
    first = sorted((r[:3], [(c[:3],) for c in r[5]]) for r in made)
    assert len(list(warc.merged(iter(first), tree))) == len(rows) and tree.most <= 6


def test_a_revisit_needs_its_record(spark):
    made = [("a", "t", 1, 300, "d", "response", None), ("b", "t", 2, None, "d", "revisit", 1)]
    schema = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    assert {r.payload_bytes for r in warc.resolved(spark.createDataFrame(made, schema)).collect()} == {300}
    for wrong in (("b", "t", 2, None, "e", "revisit", 1), ("b", "t", 2, None, "d", "revisit", 7)):
        with pytest.raises(Exception, match="not there"):
            warc.resolved(spark.createDataFrame([made[0], wrong], schema)).collect()


def test_a_very_long_page(spark):
    long = "<p>word</p>" * 400_000
    got = {r.page_id: r for r in warc.resolved(warc.capture_histories(pages(spark, [(1, "u", long), (2, "v", long), (3, "w", "x")]))).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == len(long) and got[2].refers_to == 1 and got[3].payload_bytes == 1


PAGES = [(5, "http://www.B.example/x?q=1", "y" * 200), (3, "https://a.example/", "y" * 200), (9, None, "y" * 200), (9, None, "y" * 200), (3, "https://a.example/", "y" * 200), (1, "http://c.example:80/\r\nX: y", "short"), (2, "http://c.example/é", "short"), (4, "http://[bad", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", "z" * 99)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], "page_id long, url string, html string, digest string, first long, run int")


def test_archives_read_back(spark, tmp_path):
    first = {}
    for p, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    want = []
    for p, _, h in PAGES:
        b = (h or "").encode()
        to = first.get(b) if first.get(b) != p else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    got = warc.capture_histories(pages(spark, PAGES)).collect()
    assert sorted(map(tuple, (r[:5] for r in warc.resolved(warc.capture_histories(pages(spark, PAGES))).collect())), key=repr) == sorted(want, key=repr)
    want = [(p, n if kind == "response" else None, *rest) for p, n, *rest in want for kind in rest[1:2]]
    assert sorted(map(tuple, (r[:5] for r in got)), key=repr) == sorted(want, key=repr)
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and any(r.record_type == "revisit" for r in got)
    archives = warc.write_archives(pages(spark, PAGES))
    warc.export(archives, str(tmp_path))
    whole = b"".join(gzip.decompress((tmp_path / f).read_bytes()) for f in sorted(os.listdir(tmp_path)))
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)
    assert warc.capture_histories(pages(spark, [])).count() == 0


def test_url_keys():
    assert warc.url_key("http://www2.News.example.ORG:8080/A/b?C=d") == "org,example,news:8080)/a/b?c=d"


def test_altered_copies_are_found(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(0, 3000, 25)]
    vectors += [(7, None), (8, []), (9, [None] * 64), (11, vectors[4][1])]
    df = spark.createDataFrame([(i, v, 1, "t", 2.0) for i, v in vectors], "vec_id long, embedding array<double>, chunk int, value string, scale double")
    every = media.corners(media.rendered(df), media.INDEXED)
    asked = media.corners(media.rendered(df.where("vec_id % 100 = 0"), alter=True))
    got = {(r.query_id, r.image_id): r for r in media.copies(asked, every).collect()}
    queries = {i for i, _ in vectors if i % 100 == 0}
    found = {q for q, i in got if q == i}
    assert len(found) >= 0.9 * len(queries)
    assert (100, 11) in got  # an equal image under another id
    assert {(q, i) for q, i in got if q != i} == {(100, 11)}
    assert all(got[q, q].turn == (90 if q // 100 % 3 == 0 else 0) for q in found)
    assert media.copies(asked, every.where("false")).count() == 0
    of = media.classes(every)
    assert {tuple(r) for r in of.collect()} == {(11, 11), (100, 11)}
    by_class = {(r.query_id, r.image_id): r for r in media.copies(asked, every, of).collect()}
    assert {q for q, _ in by_class} == found | {100} and by_class[100, 11].holder == 11
    assert {(q, c) for q, c in by_class if q != c} == {(100, 11)}
    # tables against comparing all descriptors
    def words(r):
        return np.array([r.d0, r.d1, r.d2, r.d3])

    a, b = asked.where("image_id = 200").collect(), every.where("image_id = 200").collect()
    near = sum(any(np.bitwise_count((words(x) ^ words(y)).view(np.uint64)).sum() <= media.MOST_APART for y in b) for x in a)
    assert got[200, 200].n_agreeing <= near

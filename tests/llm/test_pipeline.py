"""The stages in their order, each by its own rule."""

import numpy as np

import corpus_pipeline
from linework.llm import queries as q


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert got.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = got
            counts.append(got.count())
        else:
            assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert whole >= counts[0] >= counts[1] >= counts[2] == counts[3] > 0.7 * whole * 0.8


def test_stages_against_brute_force(spark, tmp_path):
    """What each stage keeps, made anew from the rows of the stage before: scores, sets of all pairs, spans of each text."""
    from linework.llm import quality, secret_scan, toxicity

    from .conftest import CLASH
    from .test_texts import RNG, brute_groups, corpus

    pairs, labels = corpus()
    known = dict(pairs)
    some = list(known)[:30]
    pairs += [(9000 + k, known[i].replace("e", "a", 1) if k % 2 else known[i]) for k, i in enumerate(some)]
    pairs += [(9500, "password=hunter22hunter and more words of a text that is kept"), (None, None), (None, ""), (9500, "password=hunter22hunter and more words of a text that is kept"), (some[0], known[some[0]])]
    RNG.shuffle(pairs)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    stage = dict(corpus_pipeline.STAGES)
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    now = listed(docs)
    for name, model, least in (("quality_classifier", quality.fit(docs, marks), True), ("toxicity", toxicity.fit(docs, marks), False)):
        scorer = model if least else model.scorer()
        one = (lambda t: scorer.score(np.array([quality.features(t)], float))[0] >= quality.THRESHOLD) if least else (lambda t: scorer.score([t])[0] < toxicity.THRESHOLD)
        want = [(i, t) for i, t in now if one((t or "").encode())]
        docs = corpus_pipeline.cut(stage[name](spark, docs, str(tmp_path)), name)
        now = listed(docs)
        assert now == want and 0 < len(now) < len(pairs)
    groups = brute_components(now, 5, 80)
    docs = corpus_pipeline.cut(stage["ngram_jaccard_join"](spark, docs, str(tmp_path)), "near")
    after = listed(docs)
    assert len(after) == len(groups)
    assert sorted(repr(i) for i, _ in after) == sorted(repr(min((r[0] for r in g if r[0] is not None), default=None)) for g in groups)
    assert brute_groups(after, 5, 80) == sorted(((i, n, i) for i, n, _ in brute_groups(after, 5, 80)), key=repr)
    docs = corpus_pipeline.cut(stage["secret_scan"](spark, docs, str(tmp_path)), "secrets")
    clean = listed(docs)
    assert len(clean) == len(after) and all(secret_scan.find(t or "")[0] == [] for _, t in clean)
    assert {i for i, _ in clean} == {i for i, _ in after} and all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect())
    whole = stage["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in whole) == len(clean)
    at = {}
    for r in sorted(whole, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def brute_components(rows, width, percent):
    """Groups of rows whose sets reach each other; rows without words are alone, but equal rows are one."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    groups, left = [], set(range(len(rows)))
    while left:
        group, todo = set(), {min(left)}
        while todo:
            i = todo.pop()
            group.add(i)
            left.discard(i)
            todo |= {j for j in left if (both := len(sets[i] & sets[j])) and 100 * both >= percent * len(sets[i] | sets[j]) or not sets[i] and rows[i] == rows[j]}
        groups.append([rows[i] for i in group])
    return groups


def test_queries_have_their_names():
    found = q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert set(q.oracle_sql()) <= set(found)

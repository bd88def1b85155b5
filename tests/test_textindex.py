"""The stored inverted index against brute force: search, segments, phrases, parameters, and vectors by cells."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.operators import ranking, semantic, textindex, vectorindex
from tessera.operators.components import components

DOCS = "doc_id long, text string"


def _random_docs(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(words, weights=[60 / (1 + j) for j in range(60)], k=r.randint(1, 60)))) for i in range(n)]


def _bm25(docs, queries, k, k1=1.5, b=0.75, whitelist=()):
    """Okapi scores by dictionaries; an idf below 0 becomes a quarter of the mean."""
    bags = {i: t.split() for i, t in docs}
    every = list(bags.values()) + ([list(whitelist)] if whitelist else [])
    n, mean = len(every), sum(map(len, every)) / len(every)
    df = {}
    for t in every:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: low if x < 0 else x for w, x in raw.items()}
    out = set()
    for q, text in queries:
        scores = []
        for i, t in bags.items():
            if set(t) & set(text.split()):
                s = sum(idf[w] * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / mean)) for w in text.split() if w in idf and w in t)
                scores.append((-round(s, 6), i))
        out |= {(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def _found(df):
    return {(x.query_id, x.doc_id, x.score, x.rank) for x in df.collect()}


def test_search_equals_brute_force_over_segments(spark, tmp_path):
    docs, queries = _random_docs(300), [(1, "w0 w1 w2"), (2, "w50 w3 w3"), (3, "w59"), (4, "nothing"), (5, " ".join(f"w{i}" for i in range(40))), (6, "")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    index = textindex.TextIndex.create(spark, str(tmp_path / "i"), buckets=4)
    assert index.add(spark.createDataFrame(docs[:200], DOCS)) == 200
    # known ids stay as they are, repeated new ones are one document, rows without tokens or id are none
    again = [(5, "other text"), (None, "w1 w2"), (900, None), (901, " .. "), *docs[200:], docs[250]]
    assert index.add(spark.createDataFrame(again, DOCS)) == 100
    want = _bm25(docs, queries, 7)
    assert _found(index.search(asked, 7)) == want
    with pytest.raises(ValueError):
        textindex.TextIndex.create(spark, str(tmp_path / "i"))
    index.merge()
    opened = textindex.TextIndex.open(spark, str(tmp_path / "i"))
    assert len(opened._manifest["segments"]) == 1 and opened.parameters["buckets"] == 4
    assert _found(opened.search(asked, 7)) == want
    opened.clean()
    assert _found(opened.search(asked, 7)) == want and opened.add(spark.createDataFrame(docs, DOCS)) == 0
    assert index.terms().agg(F.sum("freq")).first()[0] == sum(len(t.split()) for _, t in docs)


def test_another_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "i")
    a = textindex.TextIndex.create(spark, path)
    b = textindex.TextIndex.open(spark, path)
    a.add(spark.createDataFrame([(1, "x")], DOCS))
    with pytest.raises(RuntimeError):
        b.add(spark.createDataFrame([(2, "y")], DOCS))
    assert textindex.TextIndex.open(spark, path).size() == (1, 1.0)


def test_forced_terms_are_one_document_without_hits(spark, tmp_path):
    docs, queries = _random_docs(40, 3), [(1, "w0 zz w5"), (2, "zz")]
    index = textindex.TextIndex.create(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(docs, DOCS))
    assert index.force_terms(["zz", "yy", "w0"]) == 1 and index.force_terms(["zz"]) == 0
    want = _bm25(docs, queries, 5, whitelist=("zz", "yy"))
    assert _found(index.search(spark.createDataFrame(queries, "query_id long, text string"), 5)) == want
    assert {r.term for r in index.terms().where("df = 1 and term in ('zz', 'yy')").collect()} == {"zz", "yy"}


def test_empty_index(spark, tmp_path):
    index = textindex.TextIndex.create(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "x y")], "query_id long, text string")
    assert index.add(spark.createDataFrame([], DOCS)) == 0
    assert index.search(q).count() == 0 and index.phrases(q).count() == 0 and index.terms().count() == 0


def _phrase(tokens, phrase, slop):
    """Starts from which the phrase's tokens follow in order with at most slop tokens between in all."""
    n = 0
    for start in (i for i, t in enumerate(tokens) if t == phrase[0]):
        ends = {start}
        for p in phrase[1:]:
            ends = {j for e in ends for j in range(e + 1, len(tokens)) if tokens[j] == p}
        n += any(e - start - len(phrase) + 1 <= slop for e in ends)
    return n


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_equal_brute_force(spark, tmp_path, slop):
    docs = [(i, " ".join(random.Random(i).choices("abcd", k=random.Random(-i).randint(1, 14)))) for i in range(120)]
    phrases = [(1, "a b"), (2, "a a b"), (3, "d"), (4, "b c d a"), (5, "x a"), (6, "")]
    index = textindex.TextIndex.create(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(docs, DOCS))
    got = {(x.query_id, x.doc_id): x.times for x in index.phrases(spark.createDataFrame(phrases, "query_id long, text string"), slop).collect()}
    want = {(q, i): n for q, p in phrases if p for i, t in docs if (n := _phrase(t.split(), p.split(), slop))}
    assert got == want


def test_verbatim_passages(spark, tmp_path):
    rows = [(1, "the quick brown fox jumps"), (2, "xthe quick brown foxy"), (3, "The quick brown fox"), (4, "quick"), (5, "a quick"), (6, None)]
    docs = spark.createDataFrame(rows, DOCS)
    index = textindex.TextIndex.create(spark, str(tmp_path / "i"))
    index.add(docs)
    asked = [(1, "the quick brown fox"), (2, "quick"), (3, None), (4, "absent words of all")]
    got = {(x.query_id, x.doc_id) for x in textindex.verbatim(index, docs, spark.createDataFrame(asked, "query_id long, text string")).collect()}
    assert got == {(q, i) for q, p in asked if p for i, t in rows if t and p in t}


# -- vectors -----------------------------------------------------------------------------------------------------------


def _vectors(n, d=16, seed=2):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_knn_equals_brute_force_with_ties_and_odd_vectors(spark):
    x = np.round(_vectors(200, 4), 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    q = v.where("doc_id % 40 = 0 or doc_id = 903").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv"))
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in ranking.knn(v, q, 6).collect()}
    for a in range(0, 200, 40):
        order = sorted((-round(float(x[a] @ x[i]), 6), i) for i in range(200) if i != a)[:6]
        assert [got[(a, r)] for r in range(1, 7)] == [(i, -s) for s, i in order]
    assert len(got) == 5 * 6
    assert ranking.knn(v.limit(0), q, 3).count() == 0 and ranking.knn(v, q.limit(0), 3).count() == 0


def test_cells_find_most_neighbours_under_a_filter(spark, tmp_path):
    x = _vectors(1500)
    v = spark.createDataFrame([(i, [float(a) for a in r], i % 3) for i, r in enumerate(x)] + [(9999, [0.0] * 16, 0), (9998, None, 0)], "doc_id long, embedding array<double>, label int")
    index = vectorindex.VectorIndex.create(v, str(tmp_path / "v"))
    q = v.where("doc_id < 100").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv"))
    kept = F.col("label") == 1
    found = index.search(q, 10, 16, kept)
    exact = ranking.knn(v, q, 10, kept)
    assert vectorindex.recall(found, exact).first().recall >= 0.9
    assert {r.doc_id % 3 for r in found.collect()} == {1}
    plan = vectorindex.VectorIndex(spark, str(tmp_path / "v")).vectors().where(F.col("cell").isin(1, 2))
    assert len(plan.inputFiles()) < len(index.vectors().inputFiles()) or "PartitionFilters: [" in plan._jdf.queryExecution().toString()
    assert _found(index.search(q, 10, 10_000)) == _found(ranking.knn(v.where("doc_id < 9000"), q, 10))


def test_semantic_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = _vectors(60, 24, 5)
    near = [(b + rng.standard_normal(24) * s) for b, s in zip(base[:30], np.linspace(0.01, 0.12, 30), strict=True)]
    x = np.concatenate([base, near, base[:5], base[7] + rng.standard_normal((150, 24)) * 0.02])
    order = rng.permutation(len(x))
    rows = [(int(i), [float(a) for a in r]) for i, r in zip(order, x, strict=True)]
    unit = {i: np.array(r) / np.linalg.norm(r) for i, r in rows}
    parent = {i: i for i in unit}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in unit:
        for b in unit:
            if a < b and round(float(unit[a] @ unit[b]), 6) >= 0.8:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24)]
    v = spark.createDataFrame(rows + odd, "doc_id long, embedding array<double>")
    got = {r.doc_id: r.keep for r in semantic.semantic_duplicates(v).collect()}
    assert got == {i: root(i) for i in unit} | {i: i for i, _ in odd}
    assert semantic.semantic_duplicates(v.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(300, 300), (7, 5)] + [(r.randint(400, 600), r.randint(400, 600)) for _ in range(120)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


# -- unknown words -----------------------------------------------------------------------------------------------------


def test_unknown_words_are_guessed():
    words = {"我们": 50.0, "他们": 40.0, "今天": 30.0, "明天": 30.0, "军队": 20.0, "规则": 20.0, "的": 200.0, "在": 100.0, "军队规则": 5.0}
    plain, guess = segment.segmenter(words), segment.segmenter(words, unknown=True)
    assert plain("我们的军队规则") == guess("我们的军队规则") == ["我们", "的", "军队规则"]
    # 军天 is in no dictionary, but 军 begins and 天 ends words
    assert plain("我们在军天") == ["我们", "在", "军", "天"]
    assert "军天" in "|".join(guess("我们在军天")).split("|") or guess("我们军天") == ["我们", "军天"]
    assert "".join(guess("我们在軍天abc 12，龘龘")) == "我们在軍天abc12，龘龘"
    assert guess("") == [] and guess(None) == []


def test_letter_model_equals_enumeration():
    model = segment.LetterModel({"ab": 3.0, "abc": 2.0, "c": 5.0, "ba": 1.0})
    import itertools

    for run in ("ab", "abc", "cab", "bcab", "zzab"):
        best = None
        for states in itertools.product("BMES", repeat=len(run)):
            if states[0] not in "BS" or states[-1] not in "ES" or any(q not in model.step[p] for p, q in itertools.pairwise(states)):
                continue
            known = lambda x: any(x in t for t, _ in model.emit.values())
            s = model.start[states[0]] + sum(model.step[p][q] for p, q in itertools.pairwise(states)) + sum(model.emit[p][0].get(x, model.emit[p][1]) if known(x) else 0.0 for p, x in zip(states, run, strict=True))
            best = max(best or (-math.inf, ""), (s, "".join(states)))
        cut, at = [], 0
        for i, p in enumerate(best[1]):
            if p in "ES":
                cut.append(run[at : i + 1])
                at = i + 1
        assert model.cut(run) == cut

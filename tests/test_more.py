"""Operators of search, ingestion, query processing and evaluation on small inputs, and queries without SQL against brute force."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import catalog, catalog_more
from tessera.functions import segment
from tessera.operators import chunking, evaluation, ingest, learning, lexical, querying, ranking, search, vocabulary

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_tokens_of_any_script_and_segmented_text(spark):
    d = spark.createDataFrame([(1, "Für 南京市长江大桥 A1"), (2, "南京 大桥")], "doc_id long, text string")
    assert {r.term for r in lexical.term_counts(d).collect()} == {"für", "南京市长江大桥", "a1", "南京", "大桥"}
    cut = segment.segment({"南京市": 5.0, "南京": 3.0, "长江": 4.0, "大桥": 4.0, "长江大桥": 9.0, "市长": 2.0})
    q = spark.createDataFrame([(7, "南京市"), (8, "für")], "query_id long, text string")
    hits = {(r.query_id, r.doc_id) for r in lexical.bm25_scores(d, q, "lucene", tokenizer=lambda c: cut(F.lower(c))).collect()}
    assert hits == {(7, 1), (8, 1)}


def test_corpus_counts_documents_and_tokens(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "A"), (3, " "), (4, None)], "doc_id long, text string")
    got = {r.term: (r.df, r.freq) for r in lexical.corpus(d).collect()}
    assert got == {None: (2, 4), "a": (2, 3), "b": (1, 1)}
    assert lexical.corpus_size(lexical.corpus(d)).first() == (2, 2.0)
    assert {(r.gram, r.freq, r.df) for r in lexical.ngrams(d, 1, 2).collect()} == {("a", 3, 2), ("b", 1, 1), ("a b", 1, 1), ("b a", 1, 1)}


def test_holding_finds_passages_across_word_borders(spark):
    d = spark.createDataFrame([(1, "xone two three four fives"), (2, "one two three"), (3, "one two"), (4, "a,b"), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "one two three four five"), (2, "two"), (3, ","), (4, None)], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in evaluation.holding(d, q).collect()} == {(1, 1), (2, 1), (2, 2), (2, 3), (3, 4)}


@needs_data
def test_fuzzy_words_equal_all_pairs(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r.word, r.term): r.distance for r in catalog.queries()["fuzzy_words"](spark, SF).collect()}
    terms = [r.term for r in lexical.corpus(spark.read.parquet(f"{SF}/documents.parquet")).where("term is not null and freq >= 20").select("term").collect()]
    words = {w for w, _ in got}
    want = {(w, t): edits(w, t) for w in words for t in terms if edits(w, t) <= (0 if len(w) <= 2 else 1 if len(w) <= 5 else 2)}
    assert got == want and len(got) > len(words)


def test_filters_merge_without_override():
    assert search.merge_filters({}, {"content_type": "corerule"}) == {}
    assert search.merge_filters({"faction": "x", "content_type": "mine"}, {"content_type": "corerule", "chunk_type": None}) == {"faction": "x", "content_type": "mine"}
    assert search.engine("none") is search.dense and querying.processor("none") is querying.straight


@needs_data
def test_dispatch_answers_by_the_intents_engine(spark):
    got = {r.engine: (r.queries, r.results) for r in catalog.queries()["search_dispatch"](spark, SF).collect()}
    assert set(got) == {"dense", "rrf", "pipeline"} and got["rrf"][0] == 2 * got["pipeline"][0] == 2 * got["dense"][0]
    fused = catalog.queries()["search_fused"](spark, SF).collect()
    index, asked = catalog_more._index(spark, SF), catalog_more._questions(spark, SF)
    lex = {(r.query_id, r.doc_id): r["rank"] for r in lexical.top_k(lexical.bm25_scores(index, asked), 30).collect()}
    near = {(r.query_id, r.doc_id): r["rank"] for r in ranking.knn(index, asked, 30).collect()}
    for r in fused:
        k = r.query_id, r.doc_id
        assert r.score == pytest.approx(sum(1 / (20 + x[k]) for x in (lex, near) if k in x), abs=1e-6)


def test_chunk_strategy_and_blocks(spark):
    text = "# A\nintro\n### U\nlead\n*   **关键词:** x\nmore\n**技能 (Abilities):** y\n## B\n\n#### D\ndeep"
    d = spark.createDataFrame([(1, text), (2, "### U\nplain"), (3, "none")], "doc_id long, text string")
    s = chunking.sections(chunking.lines(d))
    assert {r.doc_id: r.strategy for r in ingest.strategy(s).collect()} == {1: "logical_blocks", 2: "v3_compatible", 3: "v3_compatible"}
    rows = {(r.sub_section, r.text) for r in ingest.chunk_rows(ingest.blocks(s)).where("doc_id = 1").collect()}
    assert rows == {("basic", "A.intro"), ("basic", "A-U.lead"), ("关键词", "A-U.*   **关键词:** x\nmore"), ("技能", "A-U.**技能 (Abilities):** y")}


def test_split_budget_equals_greedy_packing(spark):
    texts = ["a b。c。d e f g h。i", "", "one", "x y z w v u。", "a。b。c。d。e"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.p for r in d.select("doc_id", ingest.split_budget(F.col("text"), 3).alias("p")).collect()}
    for i, t in enumerate(texts):
        want = []
        for piece in [x + "。" for x in t.split("。")[:-1]] + [t.split("。")[-1]]:
            n = len(piece.split())
            if not piece.strip():
                continue
            if want and want[-1][1] + n <= 3:
                want[-1] = (want[-1][0] + piece, want[-1][1] + n)
            else:
                want.append((piece, n))
        assert got[i] == [x.strip() for x, _ in want]


def test_records_sinks_and_raw_store(spark, tmp_path):
    c = spark.createDataFrame([(1, "a b"), (2, "zz")], "doc_id long, text string")
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    sparse = ingest.sparse_vectors(spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (1, "c", -1.0)], "doc_id long, term string, weight double"), 1)
    got = {r.id: r for r in ingest.vector_records(c, v, sparse).collect()}
    assert got[1].sparse_values["indices"] == ["b"] and got[2].sparse_values is None and got[1].metadata["faction"] == "unknown" and got[1].metadata["chunk_id"] == "1"
    docs = {r.id: r for r in ingest.index_documents(c, v, sparse).collect()}
    assert docs[2].sparse == {} and docs[1].chunk_type == "default" and docs[1].chunk_index == 0

    def sink(rows):
        if any(r["id"] == 7 for r in rows):
            raise ValueError("seven")

    status = ingest.send(spark.range(25).coalesce(1), sink, 10).orderBy("batch").collect()
    assert [(r.n, r.ok, r.error) for r in status] == [(10, False, "seven"), (10, True, None), (5, True, None)]
    path = str(tmp_path / "raw")
    assert ingest.append_new(path, c) == 2 and ingest.append_new(path, c.union(c.selectExpr("doc_id + 5", "concat(text, '!')"))) == 2
    assert spark.read.parquet(path).count() == 4
    assert {r.doc_id for r in ingest.unknown_headings(c.withColumn("section_heading", F.col("text")), spark.createDataFrame([(1, "a b")], "doc_id long, title string")).collect()} == {2}


def test_gate_and_decisions(spark):
    q = spark.createDataFrame([(1, "Which UNITS?", "list", 0.9), (2, "units", "list", 0.2), (3, "weather", "list", 0.9), (4, None, "list", 0.9)], "query_id long, text string, intent string, confidence double")
    vocab = spark.createDataFrame([("Units",), (" ",)], "term string")
    got = {r.query_id: (r.intent, r.reply is not None) for r in querying.decide(querying.gate(q, vocab)).collect()}
    assert got == {1: ("list", False), 2: ("query", False), 3: ("non_domain", True), 4: ("non_domain", True)}
    assert querying.gate(q, vocab.limit(0)).where("known").count() == 4


@needs_data
def test_intent_decisions_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()
    got = {r.query_id: (r.known, r.canned) for r in catalog.queries()["intent_decisions"](spark, SF).collect()}
    for r in rows:
        known = any(t in r.text.lower() for t in ("the ", "und", "que la"))
        assert got[r.conv_id * 100 + r.turn][0] == known and (known or got[r.conv_id * 100 + r.turn][1])


@pytest.mark.parametrize("how", ["score", "original", "random", "levels"])
def test_fallback_variants_fill_up(spark, how):
    h = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.9, 2), (1, 3, 0.6, 3)], "query_id long, doc_id long, score double, rank int")
    rows = sorted(ranking.top_up_variant(h, 5, how).collect(), key=lambda r: r["rank"])
    ids = [r.doc_id for r in rows]
    assert len(rows) == 5 and [r.fallback for r in rows] == [False] * 3 + [True] * 2 and ids[3:] == ids[:2] and sorted(ids[:3]) == [1, 2, 3]
    if how != "random":
        assert ids[:3] == {"score": [2, 3, 1], "original": [1, 2, 3], "levels": [2, 3, 1]}[how]


def test_parameters_and_gates():
    schema = {"k": {"type": "integer", "min": 1, "max": 9}, "w": {"type": "float"}, "m": {"type": "string", "options": ["a"]}, "b": {"type": "boolean"}}
    assert ranking.check_parameters({"k": 3, "w": 1, "m": "a", "b": True, "other": 0}, schema) == []
    assert len(ranking.check_parameters({"k": 10, "w": "x", "m": "z", "b": 1}, schema)) == 4
    assert evaluation.export_gate({"intent": 0.91}, {"intent": 0.9, "slot": 0.5}) == {"intent": True, "slot": False}
    with pytest.raises(ValueError, match="unknown"):
        evaluation.evaluate({}, ["none"])


def test_evaluators_run_where_inputs_are_given(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    got = evaluation.evaluate({"run": run, "gold": gold})
    assert set(got) == {"retrieval", "novelty"} and got["retrieval"].first().mrr == 0.5


def test_answer_measures_of_empty_sides(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["x"], ["x"])], "answer array<string>, reference array<string>")
    assert sorted((r.exact, r.precision, r.recall, r.f1, r.bigram) for r in evaluation.answer_metrics(d).collect()) == [(0.0, 0.5, 0.5, 0.5, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 0.0)]
    m = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "f1 double")
    assert evaluation.safe_means(m, ["f1"]).first().f1 == 1.0


def test_importance_and_projection(spark):
    d = spark.createDataFrame([("zap zap", "a"), ("zap", "a"), ("bob", "b"), ("bob bob", "b"), ("other", "b")], "text string, label string")
    model = learning.classifier().fit(learning.with_chars(d))
    top = dict(learning.importance(model, 5))
    assert len(top) == 5 and set("".join(top)) <= set("zapbo ther")
    v = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(6)], "doc_id long, embedding array<double>")
    p = evaluation.projection(v).orderBy("doc_id").collect()
    steps = {round(abs(b.x - a.x), 6) for a, b in zip(p, p[1:])}
    assert steps == {round(5**0.5, 6)} and all(abs(r.y - p[0].y) < 1e-6 for r in p)


def test_vocabulary_views(spark):
    v = spark.createDataFrame([("units", "a", None), (None, "b", ["c"])], "category string, term string, synonyms array<string>")
    assert {(r.name, r.type, tuple(r.synonyms), r.frequency) for r in vocabulary.entity_view(v).collect()} == {("a", "units", (), 1), ("b", "general", ("c",), 1)}
    p = spark.createDataFrame([("x y",), ("a",)], "phrase string")
    assert {r.term for r in vocabulary.merged_whitelist(p, v).collect()} == {"x y", "a", "b", "c"}
    lines = spark.createDataFrame([("the 3 x",), ("of bad",), ("alone",), ("la 4",)], "value string")
    f = spark.createDataFrame([("the", 1.5), ("of", 2.0)], "term string, factor double")
    assert {r.value for r in vocabulary.rewrite_weights(lines, f).collect()} == {"the 4 x", "of 2 n", "la 4 n"}
    t = spark.createDataFrame([(1, "a"), (1, "q")], "key long, term string")
    assert [r.term for r in vocabulary.kept_terms(t, v).collect()] == ["a"]
    rules = spark.createDataFrame([(1, "a", "rule")], "doc_id long, name string, by string")
    model = spark.createDataFrame([(1, "a", "model"), (1, "b", "model")], "doc_id long, name string, by string")
    assert Counter((r.name, r.by) for r in vocabulary.first_wins(rules, model, ["doc_id", "name"]).collect()) == {("a", "rule"): 1, ("b", "model"): 1}


def test_hashed_embedding_is_a_unit_vector(spark):
    d = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    x, zero = [r.v for r in d.select(learning.hashed_embedding(F.col("t"), 8).alias("v")).collect()]
    assert sum(a * a for a in x) == pytest.approx(1.0) and zero == [0.0] * 8

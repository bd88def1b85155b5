"""Small hand-computed inputs."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import text as T
from tessera.operators import chunking, evaluation, graph, learning, lexical, querying, ranking, sequence
from tessera.sources import io


def test_hierarchy_clears_lower_headings(spark):
    d = spark.createDataFrame([(1, "# A\nx\n## B\n### C\ny\n## D\nz"), (2, "plain"), (3, "")], "doc_id long, text string")
    h = {(r.doc_id, r.line): (r.h1, r.h2, r.h3) for r in chunking.hierarchy(chunking.lines(d)).collect()}
    assert h[1, 4] == ("A", "B", "C") and h[1, 6] == ("A", "D", None) and h[2, 0] == (None, None, None)
    s = {(r.doc_id, r.section): r.content for r in chunking.sections(chunking.lines(d)).collect()}
    assert s[1, 1] == "x" and s[1, 4] == "z" and s[3, 0] == ""


def test_pack_respects_budget_and_overlap():
    parts = chunking.pack(["a b c", "d e", "f g h i j k"], 5, 1, lambda s: len(s.split()))
    assert parts == ["a b c d e", "f g h i j k"]
    assert chunking.pack([], 5, 1, len) == []
    assert chunking.pack(["a b", "c d", "e"], 4, 1, lambda s: len(s.split())) == ["a b c d", "d e"]


def test_bm25_okapi_negative_idf(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a"), (4, "d")], "doc_id long, text string")
    idf = {r.term: r.idf for r in lexical.term_stats(lexical.corpus(d)).collect()}
    assert idf["a"] > 0 and idf["b"] == pytest.approx(0.847298, abs=1e-6)


def test_normalise_constant_null_and_ranges(spark):
    h = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, None), (2, 2, 0.0), (2, 3, 4.0)], "query_id long, doc_id long, score double")
    n = {(r.query_id, r.doc_id): r.norm for r in ranking.normalise(h, "minmax").collect()}
    assert n[1, 1] == 0.5 and n[2, 1] == 0.5 and n[2, 3] == 1.0
    for m in ("auto", "clamp", "log_minmax", "zscore"):
        assert all(r.norm is None or 0 <= r.norm <= 1 for r in ranking.normalise(h, m).collect())


def test_mmr_with_full_weight_is_relevance_order(spark):
    rows = [(1, i, 1.0 - i / 10, [float(i % 2), 1.0, 0.0]) for i in range(6)]
    h = spark.createDataFrame(rows, "query_id long, doc_id long, score double, embedding array<double>")
    assert [r.doc_id for r in ranking.mmr(h, 6, 1.0).orderBy("rank").collect()] == list(range(6))
    assert [r.doc_id for r in ranking.mmr(h, 2, 0.3).orderBy("rank").collect()] == [0, 1]


def test_rrf_is_symmetric_and_validated(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, doc_id long, rank int")
    assert ranking.rrf([a, b]).collect() == ranking.rrf([b, a]).collect()
    with pytest.raises(ValueError):
        ranking.rrf([a], constant=0)


def test_metrics_count_missing_queries(spark):
    gold = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (3, 7)], "query_id long, doc_id long")
    run = spark.createDataFrame([(1, 1, 1), (2, 4, 1), (2, 5, 3)], "query_id long, doc_id long, rank int")
    m = evaluation.retrieval_metrics(run, gold, 10).first()
    assert m.hit_rate == pytest.approx(2 / 3, abs=1e-6) and m.mrr == pytest.approx((1 + 1 / 3) / 3, abs=1e-6) and m.recall == pytest.approx(0.5)


def test_bio_repair_and_spans(spark):
    rows = [(1, 0, "x", "I-A"), (1, 1, "y", "I-A"), (1, 2, "z", "I-B"), (1, 3, "o", "O"), (2, 0, "q", "B-A")]
    s = spark.createDataFrame(rows, "sent_id long, pos int, token string, label string")
    fixed = sequence.repair(s)
    assert [r.label for r in fixed.orderBy("sent_id", "pos").collect()] == ["B-A", "I-A", "B-B", "O", "B-A"]
    assert sorted((r.sent_id, r["name"], r.start, r.end, r.value) for r in sequence.spans(fixed).collect()) == [(1, "A", 0, 1, "x y"), (1, "B", 2, 2, "z"), (2, "A", 0, 0, "q")]
    assert {r.sent_id: r.valid for r in sequence.validity(s).collect()} == {1: False, 2: True}


def test_graph_upsert_and_neighbours(spark):
    v = spark.createDataFrame([(1, "a", ["x"]), (2, "b", [])], "id long, name string, aliases array<string>")
    e = spark.createDataFrame([(1, "r", 2)], "src long, rel string, dst long")
    assert graph.neighbours(v, e, "x").count() == 1 and graph.neighbours(v, e, "zz").count() == 0
    new = graph.upsert(v.withColumn("seq", F.lit(1)), v.where("id = 1").withColumn("name", F.lit("c")).withColumn("seq", F.lit(2)), ["id"], "seq")
    assert {r.id: r["name"] for r in new.collect()} == {1: "c", 2: "b"}


def test_intent_order_and_gate(spark):
    d = spark.createDataFrame([("compare all of them",), ("which one",), ("zzz",), ("",)], "text string")
    assert [r[0] for r in d.select(querying.intent(F.col("text"))).collect()] == ["compare", "list", "unknown", "unknown"]


def test_sentences_and_lists(spark):
    d = spark.createDataFrame([("One. Two! 三。四；five; six",)], "text string")
    assert d.select(T.sentences(F.col("text"))).first()[0] == ["One. Two!", "三。", "四；five;", "six"]
    d = spark.createDataFrame([("a [1] b[来源2] ",)], "text string")
    assert d.select(querying.list_answer(F.col("text"))).first()[0] == "2 items\na\nb"


def test_intent_classifier_learns(spark):
    rows = [(f"list all the items {i}", "list") for i in range(20)] + [(f"compare x with y {i}", "compare") for i in range(20)]
    d = spark.createDataFrame(rows, "text string, label string")
    model = learning.classifier().fit(learning.with_chars(d))
    p = learning.predict(model, d)
    assert p.where("prediction = y").count() == 40
    u = p.select(*[c.alias(k) for k, c in learning.uncertainty(F.col("probabilities")).items()]).first()
    assert 0 <= u.entropy <= 1


def test_conll_round_trip_and_index_upsert(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "a", "B-X"), (1, 1, "b", "I-X"), (2, 0, "c", "O")], "sent_id long, pos int, token string, label string")
    io.write_conll(s, str(tmp_path / "c"))
    assert sorted((r.pos, r.token, r.label) for r in io.conll(spark, str(tmp_path / "c")).collect()) == [(0, "a", "B-X"), (0, "c", "O"), (1, "b", "I-X")]
    path = str(tmp_path / "index")
    io.upsert_index(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), path)
    io.upsert_index(spark.createDataFrame([(2, "c")], "id long, v string"), path)
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "c"}


def test_streaming_index_equals_batch(spark, tmp_path):
    from tessera.streaming import jobs

    d = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    jobs.index_documents(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "term", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.term_counts(d).collect()))


def test_dictionaries_queries_and_reports(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    assert [tuple(r) for r in io.query_list(spark, put("q.json", '["a", "b"]')).collect()] == [(0, "a"), (1, "b")]
    assert [r.text for r in io.query_list(spark, put("m.json", '{"x": "a", "y": "b"}')).collect()] == ["a", "b"]
    assert [r.text for r in io.query_list(spark, "only this").collect()] == ["only this"]
    for text in ('{"a": {"weight": 1.5, "freq": 2}, "b": {"weight": 2}}', '{"vocabulary": {"a": 1.5, "b": 2}}', '{"a": 1.5, "b": 2}'):
        assert {tuple(r) for r in io.weighted_dictionary(spark, put("d.json", text)).collect()} == {("a", 1.5), ("b", 2.0)}
    assert {r.phrase for r in io.user_dictionary(spark, put("u.txt", "x 5 n\n\n y\nx\n")).collect()} == {"x", "y"}
    put("v_1.json", "{}"), put("v_2.json", "{}")
    assert io.latest(spark, str(tmp_path), "v_*.json").endswith("v_2.json") and io.latest(spark, str(tmp_path), "none*") is None
    p = spark.createDataFrame([("a b", 2.9)], "phrase string, weight double")
    io.write_dictionary(p, str(tmp_path / "dict"))
    assert spark.read.text(str(tmp_path / "dict" / "words")).first()[0] == "a b 2 n"
    io.write_report(p, str(tmp_path / "report"), "T")
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()][-1] == "| a b | 2.9 |"


def test_equal_sentences_stay_apart(spark, tmp_path):
    (tmp_path / "s.conll").write_text("a\tO\nb\tO\n\na\tO\nb\tO\n")
    assert io.conll(spark, str(tmp_path / "s.conll")).groupBy("sent_id").count().count() == 2


def test_cosine_histogram_counts_all_pairs(spark):
    r = random.Random(2)
    x = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    x += x[:3] + [x[0]] * 5 + [[2 * v for v in x[1]], [0.0] * 4, [0.0] * 4]
    bad = [None, [], [1.0, float("nan"), 0.0, 0.0], [None] * 4]
    d = spark.createDataFrame(list(enumerate([*x, *bad, [1.0, 0.0], [0.6, 0.8]])), "doc_id long, embedding array<double>")
    expected = Counter({12: 1})
    for a, b in itertools.combinations(x, 2):
        size = math.sqrt(sum(v * v for v in a) * sum(v * v for v in b))
        expected[math.floor(round(sum(v * w for v, w in zip(a, b)) / size if size else 0.0, 6) * 20)] += 1
    for block in (7, 1000):
        assert {q.bin: q.n for q in evaluation.cosine_histogram(d, block_rows=block).collect()} == expected


def test_knn_takes_queries_in_blocks(spark):
    r = random.Random(4)
    x = {i: [r.gauss(0, 1) for _ in range(3)] for i in range(60)}
    v = spark.createDataFrame(list(x.items()), "doc_id long, embedding array<double>")
    q = v.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (ranking.knn(v, q, 4), ranking.knn(v, q, 4, block_rows=7)):
            got = {(h.query_id, h["rank"]): h.doc_id for h in found.collect()}
            assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
            for i in x:
                best = sorted((-round(sum(a * b for a, b in zip(x[i], x[j])), 6), j) for j in x if j != i)[:4]
                assert [got[i, n] for n in range(1, 5)] == [j for _, j in best]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_dynamic_lambda_judges_the_whole_text(spark, tmp_path):
    texts = [" " * 30 + "x" * 40, "short" + " " * 60 + "and long again", "short"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r.conv_id: r.weight for r in catalog.dynamic_lambda(spark, str(tmp_path)).collect()} == {0: 0.5, 1: 0.5, 2: 0.9}

"""Dictionary jobs, hits and rerankers, chunk splitting, answer overlap, voting, interpretation, layouts, timers and stable ids on small inputs."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dictionary, evaluation, learning, ranking, results, sequence
from tessera.sources import io
from tessera.streaming import jobs


def test_containment_counts_documents(spark):
    docs = spark.createDataFrame([(1, "ab abc"), (2, "xab"), (3, None), (4, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([("ab",), ("abc",), ("zz",), ("",), ("ab",)], "phrase string")
    assert {(r.phrase, r.df) for r in dictionary.containment(docs, phrases).collect()} == {("ab", 2), ("abc", 1), ("zz", 0)}
    assert dictionary.containment(docs, phrases.limit(0)).count() == 0


def test_hits_go_to_a_reranker_and_back(spark):
    index = spark.createDataFrame([(1, "a", "f"), (2, "", None), (3, "a", "g"), (4, "b", "h")], "doc_id long, text string, faction string")
    found = spark.createDataFrame([(9, 1, 3.0, 1), (9, 2, 2.5, 2), (9, 3, 2.0, 3), (9, 4, 1.0, 4), (8, 4, 1.0, 1)], "query_id long, doc_id long, score double, rank int")
    given = results.hits(found, index)
    assert {(r.id, r.faction, r.chunk_index, r.h1) for r in given.where("query_id = 9").collect()} == {(1, "f", 0, ""), (2, "", 0, ""), (3, "g", 0, ""), (4, "h", 0, "")}
    assert {(r.query_id, r.place, r.id) for r in results.candidates(given).collect()} == {(9, 0, 1), (9, 1, 3), (9, 2, 4), (8, 0, 4)}
    new = spark.createDataFrame([(9, 2, 0.9), (9, 0, 0.1), (9, 7, 5.0)], "query_id long, place int, score double")
    assert {(r.query_id, r.rank, r.id, r.score) for r in results.put_back(given, new).collect()} == {(9, 1, 4, 0.9), (9, 2, 1, 0.1), (8, 1, 4, 1.0)}
    assert {(r.query_id, r.id) for r in results.distinct_texts(given).collect()} == {(9, 1), (9, 2), (9, 4), (8, 4)}
    few = results.ensure_results(found, 3, "no such strategy")
    assert few.where("query_id = 8").count() == 3 and few.where("query_id = 9 and fallback").count() == 0


def test_large_chunks_are_split(spark):
    text = " ".join(f"w{i}!" if i % 5 == 4 else f"w{i}" for i in range(100))
    rows = spark.createDataFrame([(1, "short one", "h"), (2, text, "h"), (3, None, "h")], "doc_id long, text string, h1 string")
    got = chunking.split_large(rows, 20, 4).orderBy("doc_id", "piece").collect()
    assert [r.text for r in got if r.doc_id == 1] == ["short one"] and all(r.h1 == "h" for r in got)
    pieces = [r.text.split() for r in got if r.doc_id == 2]
    assert all(len(p) <= 20 for p in pieces) and all(b[:4] == a[-4:] for a, b in zip(pieces, pieces[1:], strict=False))
    assert sorted({w for p in pieces for w in p}) == sorted(set(text.split()))


def test_overlap_metrics_of_known_pairs(spark):
    d = spark.createDataFrame([(1, "a b c d".split(), "a x c d".split()), (2, ["a"], ["a"]), (3, [], ["a"]), (4, None, None), (5, "a b".split(), "c d e".split())], "i int, answer array<string>, reference array<string>")
    got = {r.i: (r.rouge_l, r.rouge_2, r.bleu, r.cosine, r.edit) for r in evaluation.overlap_metrics(d).collect()}
    assert got[1] == (0.75, round(1 / 3, 6), 0.0, 0.75, 0.75) and got[2] == (1.0, 0.0, 1.0, 1.0, 1.0)
    assert got[3] == got[4] == (0.0,) * 5 and got[5] == (0.0,) * 5


def test_voters_learn_what_no_line_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["list", "all", "which"], 4)), "list") for _ in range(40)] + [(" ".join(rng.choice(["rule", "may", "can"], 4)), "rule") for _ in range(40)]
    d = spark.createDataFrame(rows, "text string, label string")
    votes = learning.Voters.fit(d, 200, 64)
    got = votes.predict(d).collect()
    assert sum(r.predicted == r.label for r in got) >= 76
    r = got[0]
    assert all(abs(v - (0.7 * a + 0.2 * b + 0.1 * c)) < 1e-9 for v, a, b, c in zip(r.probabilities, r.p_lr, r.p_kernel, r.p_rf, strict=False))
    # rings: the kernel's features part them, the plain ones don't
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rng.standard_normal((400, 2))
    y = (np.linalg.norm(x, axis=1) > 1.2).astype(float)
    ring = spark.createDataFrame([([float(a) for a in p], float(c)) for p, c in zip(x, y, strict=True)], "v array<double>, y double").withColumn("features", array_to_vector("v"))
    wide = learning.fourier_features(ring, 200, 0.5).cache()
    right = lambda col: LogisticRegression(labelCol="y", featuresCol=col, regParam=1e-3).fit(wide).transform(wide).where("prediction = y").count()
    assert right("kernel") > 370 > right("features")


def test_importance_and_rules_of_a_known_model(spark):
    d = spark.range(4000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).withColumn("y", (F.col("a") > 0.5).cast("int")).cache()
    got = {r.feature: r["drop"] for r in learning.permutation_importance(d, ["a", "b"], lambda c: (c["a"] > 0.5).cast("int"), "y").collect()}
    assert got["b"] == 0.0 and 0.4 < got["a"] < 0.6
    rules = learning.decision_rules(d, ["a", "b", "c"], "y", 2).collect()
    assert sum(r.rows for r in rules) == 4000 and {r.label for r in rules} == {0.0, 1.0} and all(r.rule.startswith("a ") for r in rules)


def test_graph_layout_keeps_more_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 20)) * 4
    x = np.concatenate([c + rng.standard_normal((10, 20)) * 0.3 for c in centres])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "doc_id long, embedding array<double>").cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    edges = [(i, int(j)) for i in range(len(x)) for j in np.argsort(-(unit[i] @ unit.T))[1:6]]
    start = evaluation.projection(v)
    points = evaluation.graph_layout(spark.createDataFrame(edges, "a long, b long"), start, 15)
    kept = lambda p: evaluation.neighbours_kept(v, p, v, 5).first().kept
    assert points.count() == 120 and kept(points) > kept(start)


def test_sentence_ids_are_the_same_for_any_split(spark, tmp_path):
    for name, n in (("b.conll", 40), ("a.conll", 25)):
        (tmp_path / name).write_text("\n\n".join(f"{name}{i}\tO\nw\tB-X" for i in range(n)))
    read = lambda: {(r.sent_id, r.pos, r.token) for r in io.conll(spark, str(tmp_path)).collect()}
    whole = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        parts = read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == parts and (0, 0, "a.conll0") in whole and (64, 0, "b.conll39") in whole and len({x[0] for x in whole}) == 65


def test_reports_names_and_training_rows(spark):
    seq = spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "B-X"), (2, 0, "c", "O")], "sent_id long, pos int, token string, label string")
    assert tuple(sequence.slot_report(seq).first()) == (2, 3, 1.5, 1, 2, 2) and sequence.slot_report(seq.limit(0)).first().sentences == 0
    rows = spark.createDataFrame([("ab", ["B-X", "I-X"]), ("ab", ["I-X", "O"]), ("ab", ["B-X", "I-Y"]), ("", []), ("a", ["B-X"])], "text string, labels array<string>")
    got = sequence.training_rows(rows).withColumn("names", sequence.slot_names(F.col("labels"))).collect()
    assert [(r.text, r.tokens, r.names) for r in got] == [("ab", ["a", "b"], ["X"]), ("a", ["a"], ["X"])]
    report = io.summary_report({"intent_accuracy": 0.5}, spark.createDataFrame([("a", "a", 2), ("a", "b", 1)], "truth string, pred string, n long"))
    assert "| intent accuracy | 0.5000 |" in report and "| a | 2 | 1 |" in report and "| b | 0 | 0 |" in report


def test_silent_answers_end_by_the_stream_s_time(spark, tmp_path):
    kind = "answer_id long, ts timestamp, seq long, piece string, last boolean"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [
        [(1, at(0), 0, "共2个 one [来源1] tw", False), (2, at(0), 0, "x [来源1] rest", False)],
        [(2, at(5), 1, " of it", True), (1, at(6), 1, "o [来", False)],
        [(3, at(40), 0, "late", False)],
        [(3, at(200), 1, "r", True)],
        [(4, at(400), 0, "z", True)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = jobs.parse_lists_timed(stream, 60, 15).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination(240)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset(provider)
    lines = lambda a, k: [r.line for r in sorted(rows, key=lambda r: r.n) if r.answer_id == a and r.kind == k]
    assert lines(1, "line") == ["共2个", "\tone [来源1]"] and lines(1, "ended") == ["two [来"] and lines(1, "alive")
    assert lines(2, "line") == ["\tx [来源1]", "rest of it"] and lines(2, "ended") == []
    assert lines(4, "line") == ["z"]


def test_unit_vectors_of_other_sizes_meet_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, qv array<double>")
    assert [tuple(r)[:3] for r in ranking.knn(v, q, 5).collect()] == [(9, 1, 1.0)]
    with pytest.raises(ValueError):
        results.top_up_variant(spark.createDataFrame([(1, 1, 1.0, 1)], "query_id long, doc_id long, score double, rank int"), 2, "none")

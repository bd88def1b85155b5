"""Sources, sinks and streams on small files."""

from __future__ import annotations

import pytest

from tessera.operators import lexical, sequence
from tessera.sources import io
from tessera.streaming import jobs


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    io.upsert_index(spark.range(200).selectExpr("id", "'a' v"), path, buckets=16)
    files = lambda: {str(f) for f in (tmp_path / "index").rglob("*.parquet")}
    before, batch = files(), spark.createDataFrame([(7, "c", 1)], "id long, v string, w int")
    for _ in range(2):
        io.upsert_index(batch, path, buckets=16)
        got = {r.id: r.v for r in spark.read.parquet(path).collect()}
        assert got == {i: "c" if i == 7 else "a" for i in range(200)}
    assert len(before - files()) == 1
    with pytest.raises(ValueError):
        io.upsert_index(batch, path, buckets=8)


def test_rewrite_keeps_a_backup(spark, tmp_path):
    path, kind = str(tmp_path / "c"), "sent_id long, pos int, token string, label string"
    io.rewrite_conll(spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "O")], kind), path)
    upper = io.conll(spark, path).selectExpr("sent_id", "pos", "upper(token) token", "label")
    io.rewrite_conll(upper, path)
    assert [[r.token for r in io.conll(spark, p).orderBy("pos").collect()] for p in (path, path + "_backup")] == [["A", "B"], ["a", "b"]]


def test_golden_set_joins_by_place(spark, tmp_path):
    n = 50
    (tmp_path / "q.csv").write_text("query,intent\n" + "".join(f"q{i},i{i % 3}\n" for i in range(n)))
    (tmp_path / "s.conll").write_text("\n\n".join(f"q{i}\tB-X\nend\tO" for i in range(n)) + "\n")
    got = io.golden_set(spark, str(tmp_path / "q.csv"), str(tmp_path / "s.conll")).orderBy("place").collect()
    assert [(r.place, r.query, r.tokens, r.labels) for r in got] == [(i, f"q{i}", [f"q{i}", "end"], ["B-X", "O"]) for i in range(n)]
    (tmp_path / "t.csv").write_text("query,intent\na,b\n")
    with pytest.raises(ValueError):
        io.golden_set(spark, str(tmp_path / "t.csv"), str(tmp_path / "s.conll"))


def test_reports_splits_logs_and_contents(spark, tmp_path):
    io.write_report(spark.range(2500).selectExpr("id", "nullif(id, 3) v"), str(tmp_path / "r"), "T")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[:4] == ["# T", "", "| id | v |", "|-|-|"] and lines[4:] == [f"| {i} | {'' if i == 3 else i} |" for i in range(2500)]
    rows = spark.createDataFrame([("a, \"b\"", "train"), ("c", "test")], "query string, split string")
    io.write_splits(rows, str(tmp_path / "s"))
    assert [[r["query"] for r in spark.read.csv(str(tmp_path / "s" / x), header=True, escape='"').collect()] for x in ("train", "test")] == [['a, "b"'], ["c"]]
    io.append_log(spark.range(10).coalesce(1), str(tmp_path / "l"), most=4)
    assert len(list((tmp_path / "l").glob("*.json"))) == 3 and spark.read.json(str(tmp_path / "l")).count() == 10
    assert {tuple(r) for r in io.dictionary_content(spark, b'{"a": 1.5}').collect()} == {("a", 1.5)}
    (tmp_path / "v").mkdir(), (tmp_path / "none").mkdir()
    (tmp_path / "v" / "k.json").write_text('{"x": {"type": "t"}}')
    assert [(r.category, r.term) for r in io.vocabulary(spark, str(tmp_path / "none"), str(tmp_path / "v")).collect()] == [("k", "x")]


def test_cleaned_sequences_and_long_labels(spark):
    kind, long = "sent_id long, pos int, token string, label string", "X" * 2000
    rows = [(i, p, t, "O") for i in range(3) for p, t in enumerate([" a", " ", "b"])] + [(9, 0, "a", "O")]
    got = sequence.cleaned(spark.createDataFrame(rows, kind))
    assert {(r.sent_id, r.pos, r.token) for r in got.collect()} == {(i, p, t) for i in range(3) for p, t in enumerate("ab")}
    for wrong in (rows[:4], [(1, 0, "a", "0"), (1, 1, "b", "O")]):
        with pytest.raises(ValueError):
            sequence.cleaned(spark.createDataFrame(wrong, kind))
    assert sequence.cleaned(spark.createDataFrame([], kind)).count() == 0
    s = spark.createDataFrame([(1, 0, "a", "B-" + long + "1"), (1, 1, "b", "I-" + long + "2")], kind)
    assert [r.label for r in sequence.repair(s).orderBy("pos").collect()] == ["B-" + long + "1", "B-" + long + "2"]


def test_documents_that_come_again_count_once(spark, tmp_path):
    kind, out = "doc_id long, text string", str(tmp_path / "out")
    for batch in ([(1, "a b"), (2, "a"), (3, "c")], [(2, "b b"), (3, " ")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        jobs.index_documents(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    now = spark.createDataFrame([(1, "a b"), (2, "b b")], kind)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "term", "tf").collect()))
    assert key(jobs.current_postings(spark, out)) == key(lexical.term_counts(now))


TEXT = "共2个 甲，射程12 [来源1,2]\n乙 [来源3] 完"
LINES = ["共2个", "\t甲，射程12 [来源1,2]", "\t乙 [来源3]", "完"]


@pytest.mark.parametrize("size", range(1, len(TEXT) + 1))
def test_list_lines_do_not_depend_on_the_pieces(size):
    got, held, headed = [], "", False
    for i in range(0, len(TEXT), size):
        lines, held, headed = jobs.list_lines(held + TEXT[i : i + size], headed)
        got += lines
    assert got + [held] == LINES


def test_list_stream_gives_out_the_last_part(spark, tmp_path):
    kind = "answer_id long, seq long, piece string, last boolean"
    for at, end in ((0, 9), (9, len(TEXT))):
        rows = [(1, i, TEXT[i], i == len(TEXT) - 1) for i in range(at, end)] + [(2, at, "x", None)]
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.parse_lists(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("parquet")
        q.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("answer_id", "n").collect()
    assert [(r.answer_id, r.n, r.line) for r in got] == [(1, n, x) for n, x in enumerate(LINES)]
    assert [r.text for r in jobs.full_text(spark.read.parquet(str(tmp_path / "in")).where("answer_id = 1")).collect()] == [TEXT]

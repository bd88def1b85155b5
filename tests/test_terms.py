"""Domain terms, alias edges, judge answers and parameter checks on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import terms


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values)).select(column.alias("x")).first().x


def test_without_term_reads_terms_literally(spark):
    of = lambda text, term: _one(spark, terms.without_term(F.col("t"), F.col("w")), t=text, w=term)
    assert of("a cat, a catalogue, cat", "cat") == "a , a catalogue, "
    assert of("a.c abc a.c", "a.c") == " abc "
    assert of("x\\Ey z", "x\\Ey") == " z"
    assert of("für fü", "fü") == "für "
    assert of("same", "") == "same" and of("same", None) == "same" and of(None, "same") is None


def test_heading_terms_follow_the_first_heading(spark):
    rows = [(1, "军队规则", "战斗专注 Battle", "先攻"), (2, "Detachment Rules", "幽冥军阵", "步兵"), (3, "unit data", "闪矛 (光, 矛) x", None), (4, "派系", "灵族", "人物"), (5, "else", "武器", "other"), (6, None, "人物", "人物"), (7, "", "人物", None)]
    found = terms.heading_terms(spark.createDataFrame(rows, "doc_id int, h1 string, h2 string, h3 string"))
    want = {(1, "mechanics", "战斗专注"), (1, "mechanics", "先攻"), (2, "detachments", "幽冥军阵"), (3, "units", "闪矛"), (3, "units", "光"), (3, "units", "矛"), (4, "factions", "灵族"), (5, "weapons", "武器")}
    assert {tuple(r) for r in found.collect()} == want


def test_family_terms(spark):
    found = terms.family_terms(spark.createDataFrame([(1, "先攻 先攻"), (2, None), (3, "")], "doc_id int, text string"), families={"mechanics": terms.FAMILIES["mechanics"]})
    assert [tuple(r) for r in found.collect()] == [(1, "mechanics", "先攻")]


def test_alias_edges_once_for_a_pair(spark):
    nodes = spark.createDataFrame([(1, "a", ["b", "b", "a"]), (2, "b", ["c"]), (3, "b", None)], "node_id int, name string, aliases array<string>")
    assert {tuple(r) for r in terms.alias_edges(nodes).collect()} == {(1, 2), (1, 3)}


def test_judge_text(spark):
    of = lambda answer: _one(spark, terms.judge_text(F.col("a")), a=answer)
    assert of('{"text": "t", "verdict": 1}') == "t"
    assert of('{"statements": ["a", null, " ", "b"]}') == "a\nb"
    assert of('{"verdict": 1, "reason": "r"}') == "r" and of('{"verdict": 0, "reason": ""}') == "0"
    assert of('{"broken": "text": "kept", ') == '{"broken": "text": "kept",' or of('{"broken": "text": "kept", ') == "kept"
    assert of("two\nlines") == "two lines" and of("") == "" and of(None) is None
    assert of("x" * 5000) == "x" * 5000


def test_checked_entities(spark):
    of = lambda answer: _one(spark, terms.checked_entities(F.col("a"), ["unit"]), a=answer)
    assert [tuple(e) for e in of('[{"text": " a ", "type": "unit"}, {"text": "b", "type": "no"}, {"type": "unit"}]')] == [("a", "unit", 0.85)]
    assert of("none") == [] and of(None) == []


def test_parameters_and_events():
    assert terms.check_bm25({"k1": 1.5, "b": 0.75, "min_freq": 1, "max_freq": 5}) == []
    assert len(terms.check_bm25({"k1": -1, "b": 2, "k3": 1, "min_freq": True})) == 4
    assert terms.check_bm25({"min_freq": 5, "max_freq": 2}) == ["min_freq must not pass max_freq"]
    assert terms.event("a\r\nb", "part") == "event: part\ndata: a\ndata: b\n\n" and terms.event("") == "data: \n\n"

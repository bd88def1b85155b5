"""Keyword scores, segmentation, masking, vocabularies, tagging and entities on small inputs."""

from __future__ import annotations

import itertools
import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import keywords, segment
from tessera.functions import text as T
from tessera.operators import chunking, fields, graph, learning, ranking, sequence, tagging, vocabulary

WEIGHTS = {"南京": 5.0, "南京市": 8.0, "市长": 4.0, "长江": 6.0, "大桥": 5.0, "长江大桥": 9.0, "江大桥": 1.0}


def _texts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_segmentation_takes_the_most_probable_words():
    cut = segment.segmenter(WEIGHTS)
    assert cut("南京市长江大桥") == ["南京市", "长江大桥"]
    assert cut("") == [] and cut("ab12 南京!") == ["ab12", "南京", "!"]
    assert segment.segmenter({})("南京 x") == ["南", "京", "x"] and segment.segmenter({}, blanks=True)("a b") == ["a", " ", "b"]


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="南京市长江大桥", max_size=8))
def test_segmentation_equals_trying_all_cuts(text):
    total = math.log(max(sum(WEIGHTS.values()), 2.0))

    def value(words):
        return sum(math.log(max(WEIGHTS.get(w, 1.0), 1.0)) - total for w in words)

    found = segment.segmenter(WEIGHTS)(text)
    assert "".join(found) == text
    every = []
    for cuts in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        words = [text[i:j] for i, j in itertools.pairwise(at)]
        if all(len(w) == 1 or w in WEIGHTS for w in words):
            every.append(value(words))
    assert not text or value(found) == pytest.approx(max(every))


def test_masking_is_longest_first_and_reversible(spark):
    d = _texts(spark, "new york city and new york", "", None, "xnewx").withColumn("m", segment.mask(["new", "new york", "york city"])("text"))
    m = {r.doc_id: r.m for r in d.collect()}
    assert m == {0: "__PHRASE_1_new york__ city and __PHRASE_1_new york__", 1: "", 2: None, 3: "x__PHRASE_0_new__x"}
    assert d.where(~segment.unmask(F.col("m")).eqNullSafe(F.col("text"))).count() == 0
    assert d.select(segment.mask([])("text").alias("m")).where("m = ''").count() == 1


def test_keyword_scores(spark):
    d = _texts(spark, "比较甲乙的射程哪个更远", "当敌人移动时触发", "", "kayword search")
    got = d.select("doc_id", keywords.position_score(F.col("text"), ["比较", "哪个"]).alias("p"), keywords.context_score(F.col("text"), ["射程", "更远"]).alias("c"), keywords.gapped_score(F.col("text"), ["当...时", "都...哪些"]).alias("g"), keywords.fuzzy_score(["keyword"])("text").alias("f"))
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[0].p, rows[0].c) == (2.0, 2.3) and rows[1].g == pytest.approx(0.4) and rows[2].p == rows[2].f == 0.0
    assert rows[3].f == pytest.approx(max(SequenceMatcher(None, "kayword search"[i : i + 7], "keyword").ratio() for i in range(8)), abs=1e-6)
    helped = d.where("doc_id = 0").select(keywords.position_score(F.col("text"), ["射程"], ["甲乙"])).first()[0]
    assert helped == 0.9
    k = keywords.structural_counts(F.col("text"), keywords.damping(F.col("text"), ["敌人"]))
    s = {r.doc_id: r for r in d.select("doc_id", *[c.alias(n) for n, c in k.items()]).collect()}
    assert s[0].comparisons == 3.0 and s[0].questions == 1.0 and s[1].chars == pytest.approx(8e-4)


def test_text_functions(spark):
    d = _texts(spark, "千面（维萨奇, 乙） AUTARCH", "无括号", "Ab9之x", "")
    name, more = T.name_and_synonyms(F.col("text"))
    rows = {r.doc_id: r for r in d.select("doc_id", name.alias("n"), more.alias("s"), T.shape(F.col("text")).alias("f"), T.cjk_part(F.col("text")).alias("c"), T.term_shapes(F.col("text")).alias("t")).collect()}
    assert (rows[0].n, rows[0].s) == ("千面", ["维萨奇", "乙"]) and (rows[1].n, rows[1].s) == ("无括号", [])
    assert rows[2].f == "Xxdxx" and rows[0].c == "千面（维萨奇 乙）" and "Ab9" in rows[2].t and rows[3].t == []
    f = d.where("doc_id = 2").select(*[c.alias(k) for k, c in T.token_features(F.col("text")).items()]).first()
    assert (f.prefix, f.suffix, f.length, f.has_number, f.has_cjk) == ("Ab", "之x", 5, True, True)
    kinds = spark.createDataFrame([("军队规则", 1, ""), ("x", 3, "m 6"), ("x", 3, "M 6"), ("", 3, "M 6"), ("步兵", 2, "")], "h string, level int, t string")
    assert [r[0] for r in kinds.select(T.content_type(F.col("h"), F.col("level"), F.col("t"))).collect()] == ["army_rule", "unit", "unit", "corerule", "unit"]


def test_vocabulary(spark):
    v = spark.createDataFrame([("units", "a", 2, ["x"]), ("skills", "a", 1, ["y"]), ("units", "b", 1, None)], "category string, term string, frequency long, synonyms array<string>")
    m = {(r.category, r.term): (r.frequency, r.synonyms) for r in vocabulary.merge(v, v.where("term = 'a'")).collect()}
    assert m["units", "a"] == (4, ["x"]) and m["units", "b"][0] == 1
    assert {r.term: (r.category, r.frequency) for r in vocabulary.by_priority(v).collect()} == {"a": ("units", 3), "b": ("units", 1)}
    assert {tuple(r) for r in vocabulary.flatten(v).collect()} == {("units", "a"), ("units", "x"), ("skills", "a"), ("skills", "y"), ("units", "b")}
    g = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a", "d\t", "d\t", ""])], "line long, terms array<string>")
    assert {tuple(r) for r in vocabulary.check_synonyms(g).collect()} == {
        (2, None, "fewer than two terms"), (3, "", "empty term"), (3, "d\t", "forbidden character"), (3, "d\t", "repeated in its group"), (3, "a", "repeated across groups")
    }


def test_crf_learns_and_its_marginals_are_exact(spark):
    import numpy as np

    crf = tagging.Crf(["A", "B", "O"])
    rng = np.random.default_rng(1)
    e, crf.step = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    paths = list(itertools.product(range(3), repeat=4))
    w = np.array([np.exp(sum(e[i, p[i]] for i in range(4)) + sum(crf.step[a, b] for a, b in itertools.pairwise(p))) for p in paths])
    marginal, pairs, z = crf.forward_backward(e)
    assert z == pytest.approx(math.log(w.sum()))
    assert marginal[2, 1] == pytest.approx(sum(x for p, x in zip(paths, w, strict=True) if p[2] == 1) / w.sum())
    assert pairs[1, 0, 2] == pytest.approx(sum(x for p, x in zip(paths, w, strict=True) if p[1:3] == (0, 2)) / w.sum())
    rows = []
    for i in range(60):
        words = ["show", "the", ["Red", "Blue"][i % 2], ["Guard", "Fleet"][i // 2 % 2], "please"][: 4 + i % 2]
        rows += [(i, j, t, {2: "B-UNIT", 3: "I-UNIT"}.get(j, "O")) for j, t in enumerate(words)]
    seq = spark.createDataFrame(rows, "sent_id long, pos int, token string, label string")
    got = tagging.tag(seq.drop("label"), tagging.fit(seq.where("sent_id < 30")))
    assert got.join(seq.withColumnRenamed("label", "gold"), ["sent_id", "pos"]).where("label = gold and confidence > 0.5").count() == len(rows)
    assert tagging.fit(seq.where("sent_id < 0")).tag([]) == ([], [])


def test_bio_encode_and_alignment(spark):
    d = spark.createDataFrame([("abcab", {"x": "ab", "w": "bc", "n": None}), ("", {}), (None, None)], "text string, slots map<string,string>")
    assert [r[0] for r in d.select(tagging.bio_encode(F.col("text"), F.col("slots"))).collect()] == [["O", "B-w", "I-w", "B-x", "I-x"], [], []]
    t = spark.createDataFrame([(1, 0, "new", 0, 3), (1, 1, "york", 4, 8), (1, 2, "is", 9, 11)], "sent_id long, pos int, token string, start int, end int")
    s = spark.createDataFrame([(1, "CITY", 0, 8)], "sent_id long, name string, start int, end int")
    assert [r.label for r in sequence.align(s, t).orderBy("pos").collect()] == ["B-CITY", "I-CITY", "O"]


def test_entities_and_relations(spark):
    p = spark.createDataFrame([("Guard", "unit", "guard"), ("Guard", "unit", "GD"), ("Leap", "skill", "leap"), ("Gun", "weapon", "gun")], "name string, type string, alias string")
    d = _texts(spark, "the Guard has Leap; guard 装备 2把 gun", "", None, "gdgd")
    found = graph.find_entities(d, p)
    assert sorted((r.doc_id, r.name, r.start, r.end) for r in found.collect()) == [(0, "Guard", 4, 9), (0, "Guard", 20, 25), (0, "Gun", 32, 35), (0, "Leap", 14, 18), (3, "Guard", 0, 2), (3, "Guard", 2, 4)]
    rel = sorted((r.src, r.dst, r.relation, r.quantity) for r in graph.relations(found, d).collect())
    assert rel == [("Guard", "Gun", "EQUIPPED_WITH", 2), ("Guard", "Leap", "HAS_SKILL", None)]
    k = spark.createDataFrame([("weapon", "24寸 攻击力：3"), ("unit", "步兵 90分"), ("skill", "x")], "kind string, text string")
    assert [r[0] for r in k.select(graph.properties(F.col("kind"), F.col("text"))).collect()] == [{"range": "24", "attacks": "3"}, {"points": "90", "unit_type": "步兵"}, {}]


def test_graph_seed_and_expansion(spark):
    v = spark.createDataFrame([("A", "unit", ["a1"], None), ("A", "unit", ["a2"], None), ("B", "unit", [], "A")], "name string, type string, aliases array<string>, parent string")
    nodes, edges = graph.seed(v)
    assert {r.name: r.aliases for r in nodes.collect()} == {"A": ["a1", "a2"], "B": []} and edges.count() == 3
    q = spark.createDataFrame([(1, "use A"), (2, "none")], "query_id long, text string")
    e = spark.createDataFrame([("A", "HAS_SKILL", "S"), ("A", "OTHER", "T")], "src string, relation string, dst string")
    got = {tuple(r) for r in graph.expand_queries(q, nodes, e).collect()}
    assert got == {(1, "use A"), (1, "A的S技能"), (1, "S技能如何使用"), (1, "use a1"), (1, "use a2"), (2, "none")}


def test_chunk_optimise_equals_a_plain_loop(spark):
    sizes = [5, 2, 2, 9, 1, 1, 1, 8, 2, 0]
    d = spark.createDataFrame([(1, 0, i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, section int, chunk int, text string")
    want: list[int] = []
    for n in sizes:
        if want and n < 3 and want[-1] + n <= 10:
            want[-1] += n
        else:
            want.append(n)
    got = chunking.optimise(d, F.size(T.words(F.col("text"))), 10).orderBy("chunk")
    assert [r.tokens for r in got.collect()] == want


def test_diversity_order_and_votes(spark):
    h = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [2.0, 0.0]), (1, 3, 0.7, [0.0, 1.0])], "query_id long, doc_id long, score double, embedding array<double>")
    assert [r.doc_id for r in ranking.reorder(h, "diversity").orderBy("rank").collect()] == [3, 1, 2]
    assert [r.doc_id for r in ranking.reorder(h, reverse=True).orderBy("rank").collect()] == [3, 2, 1]
    p = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert p.select(learning.vote([F.col("a"), F.col("b")], [3, 1])).first()[0] == [0.75, 0.25]
    assert fields.rrf_parameters(200) == {"window": 300, "constant": 20}
    with pytest.raises(ValueError):
        fields.rrf_parameters(0)


def test_split_of_a_hot_label_is_exact(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("y"))
    got = {(r.y, r.split): r["count"] for r in learning.stratified_split(d, "k", "y").groupBy("y", "split").count().collect()}
    assert got == {("hot", "test"): 180, ("hot", "val"): 90, ("hot", "train"): 630, ("rare", "test"): 20, ("rare", "val"): 10, ("rare", "train"): 70}

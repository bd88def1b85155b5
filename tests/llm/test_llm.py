"""The training-data operators on small inputs and against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, decontaminate, hashing, html_text, langid, mixing, ngram_join, quality, token_rollup, url_filter

DOC = "doc_id long, text string, lang string, source string, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x") for i, t in rows], DOC)


def test_html_main_text():
    page = '<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one  two<br>three<p>four</article><div class="comments"><p>nice read</p></div><footer>foot</footer></body></html>'
    m = html_text.default_model()
    assert m.texts([page, None, "", "<p", page[:160]])[:3] == ["A & B\none two three\nfour", "", ""]
    deep = "<div>" * 300 + "<p>x</p>"
    assert m.texts([deep])[0] in ("x", "")


def test_sum_product_equals_enumeration():
    parent, kind = np.array([-1, 0, 0, 1]), np.array([0, 0, 1, 1])
    f = html_text.Forest(parent, kind, [np.array([0]), np.array([1, 2]), np.array([3])], np.array([0.3, -0.7, 1.1, 0.2]))
    pair = np.random.default_rng(0).normal(size=(2, 2, 2))
    weight, total = np.zeros(4), 0.0
    for y in np.ndindex(2, 2, 2, 2):
        e = np.exp(sum(f.unary[i] * y[i] for i in range(4)) + sum(pair[kind[i], y[parent[i]], y[i]] for i in range(1, 4)))
        total, weight = total + e, weight + e * np.array(y)
    assert np.allclose(html_text.sum_product(f, pair)[0], weight / total)


def test_mixing_reaches_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 50)), r.choice(["a", "b", None, "d"])) for i in range(400)] + [(900, None, "a"), (None, "x y", "b"), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x["size"] for x in got)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    names = sorted(k for k in sizes if k is not None) + [None]
    w = dict(zip(names, [5, 2, 1, 5]))
    free, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(w[k] for k in free)
        full = [k for k in free if level * w[k] > 2 * sizes[k]]
        if not full:
            break
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
            free.remove(k)
    target |= {k: level * w[k] for k in free}
    for k in names:
        assert sum(x.taken for x in got if x.source == k) == pytest.approx(target[k], abs=1)
        assert all(x.target == pytest.approx(target[k]) for x in got if x.source == k)
    assert sorted(mixing.mix(d).collect(), key=str) == sorted(got, key=str)
    assert mixing.mix(d.limit(0)).count() == 0


def test_chat_links_orders_and_validates(spark):
    call = '{"tool_calls":[{"id":"c1","name":"add","arguments":{"x":1}}]}'
    rows = [(1, 0, "tool", '{"tool_call_id":"c1","content":"2"}'), (1, 1, "assistant", call), (1, 2, "user", None), (2, 0, "tool", '{"tool_call_id":"zz","content":1}'),
            (3, 0, "assistant", '{"tool_calls":[{"id":"q","name":"add","arguments":{"x":"no"}}]}'), (4, 0, None, "plain \"é\""), (None, 0, "user", "{bad")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"add": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    out = chat.format_chats(d, schema).collect()
    assert len(out) == len(rows)
    one = sorted((x for x in out if x.conv_id == 1), key=lambda x: (x.place, x.depth, x.turn))
    assert [x.turn for x in one] == [1, 0, 2] and {x.status for x in one} == {"ok"}
    assert {x.conv_id: x.status for x in out if x.conv_id in (2, 3, 4)} == {2: "orphan_result", 3: "invalid_arguments", 4: "ok"}
    assert next(x.json for x in out if x.conv_id == 4) == '{"content":"plain \\"é\\"","role":"user"}'


def test_chat_cycle_is_reported(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"v":{"$ref":"a"}}}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":1}')]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.status for x in out} == {"cycle"}


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(3)
    w = [f"w{i}" for i in range(500)]
    item = [r.choice(w) for _ in range(40)]
    near = [x if i % 6 else "zz" for i, x in enumerate(item)]
    far = [x if i % 2 else "zz" for i, x in enumerate(item)]
    d = _docs(spark, [(1, "a b " + " ".join(item).upper()), (2, " ".join(near) + " c"), (3, " ".join(far)), (4, None), (5, ""), (6, "x short one y")])
    b = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None), (10, "short one"), (None, "q")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(d, b).collect()}
    assert got == {(1, 7), (2, 7), (6, 10)}
    assert {x.doc_id for x in decontaminate.remove_contaminated(d, b, block_words=10).collect()} == {3, 4, 5}
    assert decontaminate.contamination(d, b.limit(0)).count() == 0


def _overlapping_docs(item, docs):
    """Rows of docs that overlap with the passage."""
    data, bounds = hashing.buffers(pa.array([" ".join(d) for d in docs]))
    h, at = hashing.words(data, bounds, hashing.letter_table())
    return {r for r, *_ in decontaminate.overlaps(decontaminate.build_block([1], [" ".join(item)]), h, at, 13, 0.8)}


def test_decontamination_equals_brute_force():
    """All placements of one to three different words in short passages, and longer passages of changing likeness."""
    r = random.Random(5)

    def brute(same):
        return any(sum(same[s:e]) >= max(13, 0.8 * (e - s)) for s in range(len(same)) for e in range(s + 13, len(same) + 1))

    sames = [[i not in gone for i in range(n)] for n in range(15, 19) for k in (1, 2, 3) for gone in itertools.combinations(range(n), k)]
    sames += [[i % 5 != x for i in range(n)] for n in (16, 20, 25, 40) for x in range(5)]
    sames += [[i % 4 > 0 for i in range(n)] + [True] * 14 + [i % 4 > 0 for i in range(n)] for n in (8, 40, 80)]
    sames += [[r.random() < share for _ in range(60)] for share in (0.6, 0.7, 0.75, 0.8, 0.85) for _ in range(40)]
    for n in sorted({len(x) for x in sames}):
        some, item = [x for x in sames if len(x) == n], [f"w{i}" for i in range(n)]
        docs = [["a", "b"] + [w if y else f"z{i}" for i, (w, y) in enumerate(zip(item, x))] + ["c"] for x in some]
        assert _overlapping_docs(item, docs) == {i for i, x in enumerate(some) if brute(x)}


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[0].tolist()) for i in range(40)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for y in ann.nearest(d, d.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(y.query_id, []).append(y.vec_id)
    ids, m = np.array([r[0] for r in rows[:1540]]), np.array([r[1] for r in rows[:1540]])
    hit = []
    for q in (i for i in ids if i % 20 == 0):
        s = m @ m[list(ids).index(q)]
        best = [int(i) for _, i in sorted((-v, i) for v, i in zip(s, ids) if i != q)][:10]
        hit.append(len(set(best) & set(got[q])) / 10)
    assert np.mean(hit) > 0.9 and 5001 not in got and 5000 not in got


def test_quality_separates_and_defines_edges(spark):
    rows = [(i, ("good words here and there " * 5) if i % 2 else ("$$$ %%% ### " * 9)) for i in range(120)] + [(500, None), (501, "")]
    d = _docs(spark, rows)
    y = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(d, quality.fit(d, y)).collect()}
    assert all(got[i].predicted == i % 2 for i in range(120)) and 0 <= got[500].score <= 1 and got[500].score == got[501].score
    assert quality.score(d, quality.fit(d, y.limit(0))).where("score = 0.5").count() == len(rows)


def test_language_spans_and_scripts(spark):
    rows = [(i, "the cat and the dog with that", "en", "s", "x") for i in range(20)] + [(100 + i, "кот и собака это так что", "ru", "s", "x") for i in range(20)] + [(200 + i, "der hund und die katze nicht", "de", "s", "x") for i in range(20)]
    rows += [(900, None, "en", "s", "x"), (901, "123 !!", None, "s", "x"), (902, "the dog and the cat der hund und die katze der hund", None, "s", "x"), (903, "", "en", "s", "x")]
    d = spark.createDataFrame(rows, DOC)
    m = langid.fit(d, switch=2.0)
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, m).collect()}
    assert got[3] == "en" and got[103] == "ru" and got[203] == "de" and got[900] == got[901] == got[903] == "und" and got[902] == "de"
    spans = {r.doc_id: [s.lang for s in r.spans] for r in langid.label_spans(d, m).collect()}
    assert spans[902] == ["en", "de"]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([4, 0, 6, 1])
    s = rng.normal(size=(11, 3)).astype(np.float32)
    got = langid.viterbi(s, counts, 0.8)
    for a, n in zip(np.cumsum(counts) - counts, counts):
        value = lambda y: sum(s[a + i, y[i]] for i in range(n)) - 0.8 * sum(y[i] != y[i - 1] for i in range(1, n))  # noqa: E731, B023
        assert value(got[a : a + n]) == pytest.approx(max((value(y) for y in np.ndindex(*[3] * n)), default=0), abs=1e-4)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    r = random.Random(k)
    base = [[f"w{r.randint(0, 300)}" for _ in range(r.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(700, None), (701, " \t "), (702, "ONE two"), (703, "one TWO"), (704, rows[0][1]), (None, rows[0][1])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard(_docs(spark, rows), k, percent).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = [i for i, _ in rows if i is not None]
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(sets[i]), find(i) if i is not None else None) for i in [*ids, None]}


def test_ngram_join_links_past_an_unlike_pivot(spark):
    """Two like texts share early tokens only in lists whose pivot is a third text, unlike both; nothing else links."""
    w = lambda p, n: [f"{p}0x{i}" for i in range(n)]
    head, tail, other = w("h", 4), w("t", 15), w("o", 16)
    texts = [(1, head + tail + w("a", 1)), (2, head + tail + w("b", 1)), (3, head + other), (4, head + w("f", 90))]
    texts += [(20 + i, other + w(f"e{i}y", 130 + 60 * i)) for i in range(6)] + [(10 + i, tail + w(f"d{i}y", 100 + 60 * i)) for i in range(1, 6)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in texts], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(d, k=1, percent=80).collect()}
    assert got == {i: 1 if i == 2 else i for i, _ in texts}


def test_url_rules_and_mined_rules(spark):
    rules = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow")]
    rows = [(i, f"http://bad{i % 3}.spam.org/win/{i}") for i in range(60)] + [(100 + i, f"http://ok{i}.site.org/a/{i}") for i in range(60)]
    rows += [(300, "http://WWW.Example.com/en/1?x"), (301, "https://a.example.com/en/"), (302, "http://x.com"), (303, None), (304, "nothing"), (305, "http://notexample.com/en/")]
    p = spark.createDataFrame(rows, "page_id long, url string")
    y = spark.createDataFrame([(i, i < 100) for i, _ in rows[:120]], "page_id long, blocked boolean")
    got = {r.page_id: r for r in url_filter.judge(p, y, rules).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[0].rule is None
    assert (got[300].verdict, got[300].rule, got[300].host) == ("allow", "www.example.com/en/", "www.example.com")
    assert got[301].verdict == "block" and got[302].rule is None and got[303].host == got[304].path == "" and got[305].rule == "com/"


def test_url_rules_keep_their_count_as_rows_grow(spark):
    """A host with 50 labelled URLs, all blocked, and one with 19, among 60,000 labelled ones of other hosts."""
    u = spark.range(60_000).selectExpr("id page_id", "concat('http://h', id % 500, '.site', id % 500, '.org/a', id % 500, '/', id) url")
    for at, n, host in ((100_000, 50, "bad.spam.net"), (200_000, 19, "few.rare.info")):
        u = u.union(spark.range(at, at + n).selectExpr("id page_id", f"concat('https://{host}/{host}/x?', id) url"))
    mined = url_filter.mine(u.select("url", (F.col("page_id") >= 100_000).alias("blocked")))
    held = {x for r in mined.collect() for x in r.antecedent}
    assert "host=bad.spam.net" in held and "host=few.rare.info" not in held
    asked = spark.createDataFrame([("https://bad.spam.net/",), ("http://h1.site1.org/a1/1",)], "url string")
    assert [(r.confidence, "host=bad.spam.net" in r["items"]) for r in url_filter.match(asked, mined, 1).collect()] == [(1.0, True)]


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, kind string, tokens long, old_tokens long"
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    a = spark.createDataFrame([("s", "en", "t", "insert", 5, 0), ("s", "en", "t", "insert", 7, 0), (None, None, "t", "insert", None, 0)], schema)
    b = spark.createDataFrame([("s", "en", "t", "delete", 5, 0), ("s", "en", "t", "revise", 9, 7)], schema)
    r.commit("1", a), r.commit("1", a), r.commit("2", b)
    rows = lambda: {(x.source, x.documents, x.tokens) for x in r.totals().collect()}
    assert rows() == {("s", 1, 9), (None, 1, 0)}
    r.compact()
    assert rows() == {("s", 1, 9), (None, 1, 0)} and r.commit("2", b) is False and r.commit("3", a.limit(0)) is True
    assert rows() == {("s", 1, 9), (None, 1, 0)}


def test_rollup_query_retries_and_corrects(spark, monkeypatch):
    from tessera.llm import queries

    seen, commit = [], token_rollup.Rollup.commit

    def watch(self, batch, changes):
        seen.append((batch, {r.kind for r in changes.select("kind").distinct().collect()}))
        return commit(self, batch, changes)

    monkeypatch.setattr(token_rollup.Rollup, "commit", watch)
    got = queries.token_counts(spark, "/root/testdata/sf0.001").collect()
    assert seen == [("documents", {"insert"})] * 2 + [("corrections", {"delete", "insert", "revise"})]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    count = token_rollup.counter(f"{queries.TOKENIZER_PATH}/{queries.TOKENIZER}.tiktoken", queries.TOKENIZER_PATTERN)
    every = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(count(F.col("text"))).alias("t")).collect()
    assert {(r.source, r.lang, r.documents, r.tokens) for r in got} == {(r.source, r.lang, r.n, r.t) for r in every}


def test_words_follow_the_stated_classes():
    from tessera.llm.hashing import buffers, space_table, words

    texts = ["a\x0bb  c", None, "", "é x", " \n", "A"]
    _, at = words(*buffers(pa.array(texts)), space_table())
    assert np.diff(at).tolist() == [3, 0, 0, 1, 0, 1]


def test_near_duplicates_keep_unlike_texts_of_one_doc_id(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " more"), (4, b + " more"), (None, a), (5, None), (6, c)]
    kept = P.drop_near_duplicates(spark, _docs(spark, rows), "")
    assert kept.columns == _docs(spark, rows).columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert [x for x in got if x[0] != 3] == [(0, a), (1, a), (2, b), (5, "")] and [x[1] in (c, c + " more") for x in got if x[0] == 3] == [True]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES][0] == "language_id" and len(P.STAGES) == 5
    out = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "repetition"} <= set(out.columns) and out.where(F.col("words") <= 0).count() == 0


def test_compaction_counts_a_batch_committed_meanwhile_once(spark, tmp_path, monkeypatch):
    schema = "source string, lang string, tokenizer string, kind string, tokens long, old_tokens long"
    path = str(tmp_path / "r")
    r, sums, came = token_rollup.Rollup(spark, path), token_rollup.Rollup._sums, []
    r.commit("1", spark.createDataFrame([("s", "en", "t", "insert", 5, 0)], schema))

    def meanwhile(self, base, beside):
        if not came:
            came.append(token_rollup.Rollup(spark, path).commit("2", spark.createDataFrame([("s", "en", "t", "insert", 7, 0)], schema)))
        return sums(self, base, beside)

    monkeypatch.setattr(token_rollup.Rollup, "_sums", meanwhile)
    r.compact()
    assert came == [True] and [(x.documents, x.tokens) for x in r.totals().collect()] == [(2, 12)]
    r.compact()
    assert [(x.documents, x.tokens) for x in r.totals().collect()] == [(2, 12)] and not r.commit("2", spark.createDataFrame([], schema))

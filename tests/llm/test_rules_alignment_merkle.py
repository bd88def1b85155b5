"""Certified quality rules, token alignment and the Merkle manifest against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, merkle, quality_rules, queries
from tessera.llm.store import Scratch

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
A, B = f"{queries.TOKENIZER_PATH}/byte_bpe_50k.json", f"{queries.TOKENIZER_PATH}/piece_bpe_32k.model"
needs_files = pytest.mark.skipif(not os.path.isfile(A), reason="no tokenizer files")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules -----------------------------------------------------------------------------------------------------


def _stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    t = text or ""
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in t), sum(c in "!?" for c in t))


TEXTS = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x y z\nx y z\n\n x y z\nq", "É é # | <b> ΩÉ x y", "one\r\ntwo\r\none\r\n", "ab c\x0bd\x0cab c d ab c d",
    "w " * 70_000, "same line\n" * 500, "\n".join(f"l{i % 7} x y" for i in range(300)), "z" * 300_000, "\x00 a \x00 a \x00 a",
]


def test_statistics_equal_brute_force(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab #\n\t!É") for _ in range(r.randint(0, 400))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "n", "old") for i, t in enumerate(texts)], "doc_id long, text string, N_Words string, kept string")
    got = {x.doc_id: tuple(x[c] for c in quality_rules.STATS) + (x.base_failed,) for x in quality_rules.measure(docs).collect()}
    for i, t in enumerate(texts):
        want = _stats(t)
        assert got[i] == want + (want[0] < 50 or 100 * want[4] > 50 * want[0],), (i, t and t[:60])
    assert quality_rules.measure(docs.limit(0)).count() == 0


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (40, 0.05), (2000, 0.005), (30_000, 0.01)):
        for k in sorted({0, 1, 2, int(n * p) // 2, max(0, int(n * p) - 1)}):
            if k < n * p:
                want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) if n < 100 else math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
                assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.binomial_tail(0, 0, 0.1) == 1.0 and quality_rules.binomial_tail(5, 5, 0.1) == 1.0
    assert 3e-6 < quality_rules.binomial_tail(4_990_000, 10**9, 0.005) < 4.5e-6  # 4.48 deviations below the mean


def _labelled(spark, n, strata):
    """Good documents have few symbols, bad ones many; n of each stratum, every sixth bad."""
    r = random.Random(5)
    rows = []
    for s, lang in enumerate(strata):
        for i in range(n):
            bad = i % 6 == 0
            share = r.uniform(0.4, 0.9) if bad else r.uniform(0.0, 0.3)
            w = [f"w{r.randint(0, 9999)}" + ("#" if r.random() < share else "") for _ in range(60)]
            rows.append((s * n + i, " ".join(w), lang, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_certified_cutoffs_limit_false_rejections(spark):
    docs = _labelled(spark, 1500, ["en", None]).unionByName(_labelled(spark, 40, ["xx"]).withColumn("doc_id", F.col("doc_id") + 100_000)).cache()
    measured = quality_rules.measure(docs.drop("quality"))
    rules = (quality_rules.RULES[0], quality_rules.RULES[2])
    found = quality_rules.thresholds(measured, docs, rules=rules, alpha=0.02)
    rows = {(x.stratum, x.rule): x for x in found.collect()}
    assert set(rows) == {("en", "symbols"), (None, "symbols")}  # forty documents certify nothing
    # brute force over the chains, tail by tail
    y = {x.doc_id: x for x in docs.collect()}
    stats = {i: _stats(x.text) for i, x in y.items()}
    learns = {i: zlib.crc32(str(i).encode()) % 4 == 0 for i in y}
    chains = 6
    for lang in ("en", None):
        best, certified = None, True
        mine = [i for i in y if y[i].lang == lang]
        for c in rules[0].cutoffs:
            above = [i for i in mine if stats[i][2] / stats[i][0] > c]
            n = sum(y[i].quality == 1 and not learns[i] for i in mine)
            k = sum(y[i].quality == 1 and not learns[i] for i in above)
            certified = certified and quality_rules.binomial_tail(k, n, 0.01) <= 0.1 / chains
            gain = sum(1 - 2 * y[i].quality for i in above if learns[i])
            if certified and gain > 0 and (best is None or gain > best[0]):
                best = (gain, c, n, k)
        x = rows[(lang, "symbols")]
        assert (x.cutoff, x.n, x.false_rejections) == best[1:]
    judged = quality_rules.judge(measured, found, rules=rules).join(docs.select("doc_id", F.col("quality").alias("q")), "doc_id").collect()
    for lang in ("en", None):
        good = [x for x in judged if x.lang == lang and x.q == 1]
        bad = [x for x in judged if x.lang == lang and x.q == 0]
        assert sum(not x.kept for x in good) <= 0.02 * len(good) and sum(not x.kept for x in bad) > 0.8 * len(bad)
    assert all(x.kept for x in judged if x.lang == "xx")


def test_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 60, "en"), (None, None, None), (1, " ".join(f"x{i}" for i in range(60)), "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id long, quality int")
    m = quality_rules.measure(docs)
    got = quality_rules.judge(m, quality_rules.thresholds(m, none)).collect()
    assert sorted((x.n_words, x.kept) for x in got) == [(0, False), (60, False), (60, True)]
    e = quality_rules.measure(docs.limit(0))
    assert quality_rules.judge(e, quality_rules.thresholds(e, none)).count() == 0


# -- token alignment ---------------------------------------------------------------------------------------------------

ALIGNED = [
    (1, "The quick brown fox, 12 words; naïve café — 日本語 text."), (2, None), (3, ""), (4, "two  spaces and\ttabs\n"), (5, "The quick brown fox"), (6, "The quick brown fox"),
    (7, "▁ is a piece mark"), (8, "<|endoftext|> <s> </s> <0x41>"), (9, " nbsp ﬁ ligature ﬀ"), (None, "no id at all"), (10, "x" * 5000), (11, "word " * 3000 + "end"), (12, " lead"), (13, "a" + " " * 60_000 + "b"),
    (14, "😀 emoji \U0001f468‍\U0001f469 done"), (15, "\x00\x01 control"),
]


def _brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text by offsets in dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    alphabet = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    out, links, counts = [], [], Counter()
    for t in texts:
        x, y = ([], []) if not t else (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))
        xb, yb = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x], [piece(b.id_to_piece(i)) for i in y]
        if t and not b"".join(xb) == b"".join(yb) == (" " + t).encode():
            x, y, xb, yb = [], [], [], []
        ends = []
        for parts in (xb, yb):
            at, e = 0, {}
            for i, p in enumerate(parts):
                at += len(p)
                e[at] = i
            ends.append(e)
        both = sorted(set(ends[0]) & set(ends[1]))
        pairs = [(x[ends[0][e]], y[ends[1][e]]) for e in both]
        counts.update(pairs)
        i = j = 0
        groups = []
        for e in both:
            k, m = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        links.append(pairs)
        out.append([len(x), len(y), len(both), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    top = Counter()
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return [tuple(r[:4] + [sum(counts[p] == top[p[1]] for p in ps), sum(counts[p] for p in ps), r[4]]) for r, ps in zip(out, links, strict=True)]


def _aligned(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@needs_files
def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ALIGNED + ALIGNED[:1]], "doc_id long, text string, groups string, row int")
    want = sorted(((i, *v) for (i, _), v in zip(ALIGNED + ALIGNED[:1], _brute([t for _, t in ALIGNED + ALIGNED[:1]]), strict=True)), key=str)
    assert _aligned(alignment.digest(alignment.align(docs, A, B))) == want
    assert alignment.digest(alignment.align(docs.limit(0), A, B)).count() == 0
    spell = lambda g: hashlib.sha256(";".join(",".join(map(str, x.a)) + "|" + ",".join(map(str, x.b)) for x in g).encode()).hexdigest() if g else ""
    found = alignment.groups(alignment.align(docs, A, B)).collect()
    assert sorted(((x.doc_id, x.n_a, x.n_b, len(x.groups), spell(x.groups)) for x in found), key=str) == [(w[0], w[1], w[2], w[3], w[7]) for w in want]


@needs_files
def test_each_stretch_is_encoded_once_and_alike(spark):
    a, b = alignment._loaded(alignment.Bytes, A), alignment._loaded(alignment.Pieces, B)
    assert a.apart and b.apart
    met = alignment.Stretches(a, b)
    assert [p.tolist() for p in met.places(["the cat's hat, 12"] * 1000)] == [[0, 1, 2, 3]] * 1000
    n = [len(x) for x in met.ids]
    assert met.places([None, "12 hat,"])[1].tolist() == [3, 2] and [len(x) for x in met.ids] == n
    r = random.Random(3)
    bits = ["the", "cat's", "'s", "x▁", "▁", " ", "  ", "\t", "\n", "\u00a0", "\u3000", "\x1c", "日本", "é", "e\u0301", "12", "--", "<s>", "\x00", "😀", "Wort"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", " "]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    docs = spark.createDataFrame(ALIGNED + list(enumerate(texts, 100)), "doc_id long, text string").repartition(3)
    found = _aligned(alignment.digest(alignment.align(docs, A, B)))
    assert found == sorted(((i, *v) for (i, _), v in zip(ALIGNED + list(enumerate(texts, 100)), _brute([t for _, t in ALIGNED] + texts), strict=True)), key=str)


@needs_files
def test_large_counts_meet_by_shuffle(spark):
    docs = spark.createDataFrame(ALIGNED, "doc_id long, text string")
    rows = Scratch(spark, "test").cut(alignment.align(docs, A, B).select("row", alignment.links().alias("links")))
    counts = alignment.pair_counts(rows)
    assert sorted(map(tuple, alignment.held_against(rows, counts, most=0).collect())) == sorted(map(tuple, alignment.held_against(rows, counts).collect()))


@needs_files
@needs_data
def test_alignment_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = sorted(((d.doc_id, *v) for d, v in zip(docs, _brute([d.text for d in docs]), strict=True)), key=str)
    assert _aligned(queries.queries()["op12_token_alignment"](spark, SF)) == want


# -- Merkle manifest ---------------------------------------------------------------------------------------------------


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _paths(nodes, fan):
    """The last node and the (before, after) siblings of each node, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % fan
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fan])))
        at = [p // fan for p in at]
        nodes = [_h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


@pytest.mark.parametrize(("fan", "depth"), [(2, 12), (2, 2), (3, 1), (4, 2)])
def test_manifest_equals_brute_force(spark, fan, depth):
    r = random.Random(fan * depth)
    rows = [(i, r.choice(["en", "de", "é", None, "z"]), _h(str(i))) for i in range(150)] + [(900, "one", _h("x")), (None, "en", _h("n")), (7, "en", _h("b")), (7, "en", _h("a")), (7, "en", _h("a"))]
    leaves = spark.createDataFrame([(*x, "more", 1.5) for x in rows], "doc_id long, lang string, leaf string, path string, block double").repartition(5)
    got = merkle.manifest(leaves, carry=("block",), fan=fan, depth=depth)
    groups = {}
    for x in rows:
        groups.setdefault(x[1], []).append(x)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, want = [], []
    for g in order:
        mine = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        top, paths = _paths([x[2] for x in mine], fan)
        tops.append(top)
        want.append((mine, top, paths))
    root, upper = _paths(tops, fan)
    expected = sorted(((x[0], x[1], x[2], top, root, p + up) for (mine, top, paths), up in zip(want, upper, strict=True) for x, p in zip(mine, paths, strict=True)), key=str)
    found = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((x.doc_id, x.lang, x.leaf, x.subroot, x.root, [tuple(s) for s in x.path]) for x in found), key=str) == expected
    assert all(x.folded == root and x.block == 1.5 for x in found)


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, None, _h("x"))], "doc_id long, lang string, leaf string")
    x = merkle.manifest(one).withColumn("proof", merkle.proof(F.col("path"))).collect()[0]
    assert (x.subroot, x.root, x.proof, list(x.path)) == (_h("x"), _h("x"), _h(""), [])
    assert merkle.manifest(one.limit(0)).count() == 0


def test_leaf_spells_nulls_and_bytes(spark):
    row = spark.createDataFrame([(12, None, "é", 2**63 - 1, "")], "a long, b string, c string, d long, e string")
    assert row.select(merkle.leaf(*map(F.col, "abcde"))).first()[0] == _h("2:12", "-", "2:é", f"19:{2**63 - 1}", "0:")

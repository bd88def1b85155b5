"""Entities and relations from text, and a property graph of vertices and edges as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded

#: Aliases that a search takes at most; they are sent to every worker.
MAX_ALIASES = 1_000_000
# Fixed values: (kind, property, pattern) of entities.
PROPERTIES = [
    ("weapon", "range", r"(\d+)寸"),
    ("weapon", "attacks", r"攻击力[：:]\s*(\d+)"),
    ("weapon", "strength", r"力量[：:]\s*(\d+)"),
    ("unit", "points", r"(\d+)分"),
    ("unit", "unit_type", r"(步兵|骑兵|载具)"),
    ("skill", "phase", r"((?:近战|射击|移动|冲锋)阶段)"),
]
# Fixed values: (kind, kind, pattern between them, relation).
RELATIONS = [
    ("unit", "skill", r"拥有|获得|使用|has|gain|use", "HAS_SKILL"),
    ("skill", "phase", r"在.*阶段|in.*phase|当.*时|when", "ACTIVATES_IN"),
    ("unit", "weapon", r"装备|携带|equipped|carry", "EQUIPPED_WITH"),
    ("skill", "unit", r"提供|给予|造成|provides|gives|deals", "PROVIDES_EFFECT"),
    ("skill", "weapon", r"提供|给予|造成|provides|gives|deals", "PROVIDES_EFFECT"),
    ("rule", "phase", r"适用于|在.*中|applies in|during", "APPLIES_IN"),
]
# Sentences that a relation adds to a query.
EXPANSIONS = [
    ("HAS_SKILL", ["src", "的", "dst", "技能"]),
    ("HAS_SKILL", ["dst", "技能如何使用"]),
    ("EQUIPPED_WITH", ["src", "装备的", "dst"]),
    ("EQUIPPED_WITH", ["dst", "武器属性"]),
    ("ACTIVATES_IN", ["src", "在", "dst", "中的效果"]),
]


def match_entities(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, name, type, times): single-token names by an equi-join on tokens; patterns: (name, type, alias)."""
    t = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("alias")).groupBy("doc_id", "alias").agg(F.count(F.lit(1)).alias("times"))
    return t.join(patterns, "alias").groupBy("doc_id", "name", "type").agg(F.sum("times").alias("times"))


def entity_pairs(found: DataFrame) -> DataFrame:
    """(a, b, docs): ordered pairs of different entities in one document. Bounded by the squared number of patterns a document."""
    a = found.select("doc_id", F.col("name").alias("a"))
    b = found.select("doc_id", F.col("name").alias("b"))
    return a.join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Vertices or edges by key, the row of the largest ``order`` each."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*")


def neighbours(vertices: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(src, rel, dst) around the vertices with the name or alias. vertices: (id, name, aliases); edges: (src, rel, dst)."""
    v = vertices.where((F.col("name") == name) | F.array_contains("aliases", name)).select("id")
    out = edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.select("src", "rel", "dst").union(edges.join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")).distinct()


def search_entities(vertices: DataFrame, text: str, most: int = 10) -> DataFrame:
    return vertices.where(F.col("name").contains(text) | F.array_contains("aliases", text)).orderBy("name").limit(most)


def relation(kind_a: Column, kind_b: Column, context: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    """The first rule (kind a, kind b, context pattern, relation) that fits, or null."""
    out = F.lit(None).cast("string")
    for a, b, pattern, rel in reversed(rules):
        out = F.when((kind_a == a) & (kind_b == b) & context.rlike(pattern), rel).otherwise(out)
    return out


def find_entities(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, name, type, start, end, confidence): every occurrence of any alias of (name, type, alias), in any case.

    Aliases are a dictionary of a bounded size (``MAX_ALIASES``, checked), which one automaton a worker searches for in a
    single pass over each text. start is 0-based; confidence is twice the share of the text, at most 1.
    """
    known = patterns.select(F.lower("alias"), "name", "type").where("alias <> ''").distinct().limit(MAX_ALIASES + 1).collect()
    if len(known) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    rows = docs.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in known))

    @F.pandas_udf("array<struct<name:string,type:string,start:int,end:int,confidence:double>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        by_alias: dict[str, list[tuple[str, str]]] = {}
        for alias, name, kind in rows.value:
            by_alias.setdefault(alias, []).append((name, kind))
        machine = ahocorasick.Automaton()
        for alias, names in by_alias.items():
            machine.add_word(alias, (len(alias), names))
        if by_alias:
            machine.make_automaton()

        def one(text: str | None) -> list[dict]:
            if not text or not by_alias:
                return []
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            return [{"name": x, "type": t, "start": e - n + 1, "end": e + 1, "confidence": min(2 * n / len(text), 1.0)} for e, (n, names) in machine.iter(low) for x, t in names]

        for texts in batches:
            yield texts.map(one)

    return docs.select("doc_id", F.explode(search("text")).alias("x")).select("doc_id", "x.*").withColumn("confidence", F.round("confidence", 6))


def properties(kind: Column, text: Column) -> Column:
    """A map of the numbers and words that a text gives for an entity of a kind; absent ones are left out."""
    found = [F.struct((kind == k).alias("on"), F.lit(n).alias("key"), F.regexp_extract(text, p, 1).alias("value")) for k, n, p in PROPERTIES]
    return F.map_from_entries(F.transform(F.filter(F.array(*found), lambda x: x["on"] & (x["value"] != "")), lambda x: F.struct(x["key"], x["value"])))


def relations(found: DataFrame, docs: DataFrame, rules: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """(doc_id, src, dst, relation, quantity, condition): pairs of entities in one text whose kinds and the text between them fit a rule.

    The pairs are of distinct names whose kinds some rule joins, by their first places, so a long text with many
    occurrences yields no more pairs than a short one.
    """
    rules = rules or RELATIONS
    first = found.groupBy("doc_id", "name", "type").agg(F.min(F.struct("start", "end")).alias("p")).select("doc_id", "name", "type", "p.*")
    a = first.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in ("name", "type", "start", "end")])
    b = first.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("name", "type", "start", "end")])
    kinds = F.struct("a_type", "b_type").isin(*[F.struct(F.lit(x), F.lit(y)) for x, y in sorted({r[:2] for r in rules})])
    pairs = a.join(b, "doc_id").where(kinds & (F.col("a_name") != F.col("b_name"))).join(docs.select("doc_id", "text"), "doc_id")
    lo, hi = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    context = F.substring(F.col("text"), lo + 1, hi - lo)
    out = pairs.withColumn("context", context).withColumn("relation", relation(F.col("a_type"), F.col("b_type"), F.col("context"), rules)).where("relation is not null")
    number = F.when(F.col("relation") == "EQUIPPED_WITH", F.regexp_extract("context", r"(\d+)[个把件]", 1).try_cast("int"))
    condition = F.when(F.col("relation") == "HAS_SKILL", F.nullif(F.regexp_extract("context", r"(当.*时|if.*then|when)", 1), F.lit("")))
    return out.select("doc_id", F.col("a_name").alias("src"), F.col("b_name").alias("dst"), "relation", number.alias("quantity"), condition.alias("condition"))


def seed(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (name, type, aliases, parent) as a graph: (id, name, type, aliases) unique by name, and edges to aliases and parents."""
    v = vertices.groupBy("name").agg(F.min("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"), F.min("parent").alias("parent"))
    v = v.withColumn("id", F.xxhash64("name"))
    alias = v.select(F.col("id").alias("src"), F.lit("HAS_ALIAS").alias("rel"), F.explode("aliases").alias("a")).select("src", "rel", F.xxhash64("a").alias("dst"))
    up = v.where("parent is not null").select(F.col("id").alias("src"), F.lit("SUBFACTION_OF").alias("rel"), F.xxhash64("parent").alias("dst"))
    return v.select("id", "name", "type", "aliases"), alias.unionAll(up)


def expand_queries(queries: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, text): each query, sentences from the relations of the entities that it names, and itself with their aliases.

    queries: (query_id, text), a stated batch; vertices: (name, aliases); edges: (src, relation, dst) by name.
    """
    q = queries.select("query_id", "text")
    hit = vertices.join(bounded(q), F.col("text").contains(F.col("name"))).select("query_id", "text", "name", "aliases")
    by = [F.struct(F.lit(r).alias("r"), F.concat(*[F.col(p) if p in ("src", "dst") else F.lit(p) for p in parts]).alias("t")) for r, parts in EXPANSIONS]
    rel = hit.join(edges, F.col("name") == F.col("src")).select("query_id", F.explode(F.transform(F.filter(F.array(*by), lambda x: x["r"] == F.col("relation")), lambda x: x["t"])).alias("text"))
    swap = hit.select("query_id", "text", "name", F.explode("aliases").alias("alias")).where("alias <> name").select("query_id", F.replace("text", F.col("name"), F.col("alias")).alias("text"))
    return q.unionAll(rel).unionAll(swap).distinct()

"""Domain terms of chunks by their headings and text, alias edges, explained scores, and repaired judge answers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_part, name_and_synonyms

# Fixed values: (category, words in the first heading, levels that name terms); the first that fits counts.
HEADING_RULES = [
    ("mechanics", ["军队规则", "army rule"], ("h2", "h3")),
    ("detachments", ["分队规则", "detachment rule"], ("h2",)),
    ("units", ["阿苏焉尼单位数据", "unit data"], ("h2", "h3")),
    ("factions", ["派系", "faction"], ("h2",)),
]
# Patterns of term families.
FAMILIES = {
    "units": r"([A-Za-z一-鿿]+（[A-Za-z一-鿿]+）|[A-Za-z一-鿿]+(?:\s+[A-Z]+)?)",
    "weapons": r"([A-Za-z一-鿿]+[·\s]+[A-Za-z一-鿿]+|[A-Za-z一-鿿]+武器)",
    "skills": r"([A-Za-z一-鿿]+专注|[A-Za-z一-鿿]+动作|[A-Za-z一-鿿]+能力)",
    "mechanics": r"(战斗专注|殊途同归|致命破灭|深入打击|先攻|连击|移动阶段|射击阶段|冲锋阶段|近战阶段|士气测试|装甲保护)",
}
# Fixed values: (category, heading level, words) by which a pair of headings is judged.
LEVEL_WORDS = [
    ("units", "h2", ["人物", "战线", "载具", "骑乘", "巨兽", "步兵"]),
    ("weapons", "h2", ["武器", "射击", "近战"]),
    ("mechanics", "h1", ["规则", "技能"]),
    ("factions", "h1", ["派系", "种族"]),
]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])


def heading_tokens(heading: Column) -> Column:
    """CJK parts of a heading cut at commas, bars, slashes and white space; parts without any are left out."""
    return F.filter(F.transform(F.split(heading, r"[,|/\s]+"), cjk_part), lambda x: x != "")


def without_term(text: Column, term: Column) -> Column:
    """The text without whole-word occurrences of a term, which is read literally; an empty or null term changes nothing."""
    bare = F.regexp_replace(text, F.concat(F.lit(r"(?U)\b\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b")), F.lit(""))
    return F.when(F.coalesce(term, F.lit("")) == "", text).otherwise(bare)


def heading_category(h1: Column, h2: Column) -> Column:
    """units, weapons, mechanics or factions by words of two headings; else general."""
    at, out = {"h1": h1, "h2": h2}, F.lit("general")
    for name, level, words in reversed(LEVEL_WORDS):
        out = F.when(_any(at[level], words), name).otherwise(out)
    return out


def heading_terms(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category, term): terms that the second and third headings name, by what the first one announces.

    Units give their names and synonyms apart, other categories the CJK part of the heading, if any. Without an announcing
    first heading, both levels are judged by their own words and general ones are left out.
    """
    rule = F.lit(None).cast("string")
    for name, words, _ in reversed(HEADING_RULES):
        rule = F.when(_any(F.col("h1"), words), name).otherwise(rule)
    levels = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("heading")) for x in ("h2", "h3")])
    x = chunks.where(F.coalesce("h1", F.lit("")) != "").select(key, "h1", rule.alias("rule"), F.explode(levels).alias("at")).select(key, "h1", "rule", "at.*")
    named = reduce(lambda a, b: a | b, [(F.col("rule") == n) & F.col("level").isin(list(ls)) for n, _, ls in HEADING_RULES])
    category = F.when(F.col("rule").isNull(), heading_category(F.col("h1"), F.col("heading"))).when(named, F.col("rule"))
    name, synonyms = name_and_synonyms(F.col("heading"))
    terms = F.when(F.col("category") == "units", F.concat(F.array(name), synonyms)).otherwise(F.array(cjk_part(F.col("heading"))))
    x = x.withColumn("category", category).where(F.col("category").isNotNull() & (F.col("category") != "general") & F.col("heading").isNotNull())
    return x.select(key, "category", F.explode(terms).alias("term")).where(F.length("term") > 0).distinct()


def family_terms(rows: DataFrame, key: str = "doc_id", families: dict[str, str] | None = None) -> DataFrame:
    """(key, category, term): distinct matches of each family's pattern in a text."""

    def matches(name: str, pattern: str) -> Column:
        every = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
        return F.transform(every, lambda t: F.struct(F.lit(name).alias("category"), t.alias("term")))

    found = [matches(n, p) for n, p in (families or FAMILIES).items()]
    return rows.where(F.col("text").isNotNull()).select(key, F.explode(F.concat(*found)).alias("x")).select(key, "x.*")


def chunk_terms(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(category, term, n): terms of headings, and the mechanics that core-rule texts name beside them, by number of chunks."""
    mechanics = family_terms(chunks.where(F.col("content_type") == "corerule"), key, {"mechanics": FAMILIES["mechanics"]})
    every = heading_terms(chunks, key).unionByName(mechanics).distinct()
    return every.groupBy("category", "term").agg(F.count(F.lit(1)).alias("n"))


def zip_entities(queries: DataFrame, entities: DataFrame, key: str = "position") -> DataFrame:
    """Each query with the entity of its position; queries beyond the entities have null."""
    return queries.join(entities, key, "left")


def alias_edges(nodes: DataFrame) -> DataFrame:
    """(node_id, alias_id): nodes whose alias is another node's name. One row for a pair, however often it is stated."""
    given = nodes.select("node_id", F.explode("aliases").alias("name")).distinct()
    named = nodes.select(F.col("node_id").alias("alias_id"), "name")
    return given.join(named, "name").where("node_id <> alias_id").select("node_id", "alias_id").distinct()


def explained(parts: DataFrame, lexical: list[str], dense: list[str]) -> DataFrame:
    """(query_id, doc_id, score, text_similarity, vector_similarity): a fused hit's sums of lexical and dense components."""
    total = lambda names: F.round(sum(F.coalesce(F.col(n), F.lit(0.0)) for n in names), 6)
    return parts.select("query_id", "doc_id", "score", total(lexical).alias("text_similarity"), total(dense).alias("vector_similarity"))


def sparse_diagnostics(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, terms, least, most, mean): the size of each sparse vector and the spread of its weights."""
    w = F.col("weight")
    return weights.where(w > 0).groupBy(key).agg(F.count(F.lit(1)).alias("terms"), F.round(F.min(w), 6).alias("least"), F.round(F.max(w), 6).alias("most"), F.round(F.avg(w), 6).alias("mean"))


def judge_text(answer: Column) -> Column:
    """The text that a judge's JSON answer holds.

    Its ``text``; else its statements a line each, its verdict's reason, or the verdict. An answer that isn't a JSON object
    or has none of them gives its first quoted ``text`` value, or itself on one line. Nothing is cut. Null gives null.
    """
    get = lambda path: F.get_json_object(answer, path)
    statements = F.from_json(get("$.statements"), "array<string>")
    lines = F.when(statements.isNotNull(), F.array_join(F.filter(statements, lambda s: F.trim(s) != ""), "\n"))
    reason = F.when(F.length(get("$.reason")) > 0, get("$.reason"))
    quoted = F.regexp_extract(answer, r'"text"\s*:\s*"([^"]*)"', 1)
    bare = F.trim(F.regexp_replace(answer, r"[\n\r]", " "))
    loose = F.when(quoted != "", quoted).otherwise(bare)
    return F.coalesce(get("$.text"), lines, F.when(get("$.verdict").isNotNull(), F.coalesce(reason, get("$.verdict"))), loose)


def checked_entities(answer: Column, kinds: list[str], confidence: float = 0.85) -> Column:
    """Entities of a model's JSON list whose type is known, each with a fixed confidence; anything else gives an empty list."""
    found = F.from_json(answer, "array<struct<text:string,type:string>>")
    good = F.filter(F.coalesce(found, F.array().cast("array<struct<text:string,type:string>>")), lambda e: e["type"].isin(kinds) & (F.length(F.trim(e["text"])) > 0))
    return F.transform(good, lambda e: F.struct(F.trim(e["text"]).alias("text"), e["type"].alias("type"), F.lit(confidence).alias("confidence")))


#: Parameters of the lexical weights and the bounds that they must keep.
BM25_BOUNDS = {"k1": (0.0, 10.0), "b": (0.0, 1.0), "min_freq": (1, None), "max_freq": (1, None)}


def check_bm25(values: dict) -> list[str]:
    """What is wrong with lexical parameters, a line for each; none if all is well."""
    wrong = [f"{n} is unknown" for n in sorted(set(values) - set(BM25_BOUNDS))]
    for n, (lo, hi) in BM25_BOUNDS.items():
        v = values.get(n)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < lo or (hi is not None and v > hi)):
            wrong.append(f"{n} must be a number of {lo} or more" + (f" and at most {hi}" if hi is not None else ""))
    if not wrong and None not in (values.get("min_freq"), values.get("max_freq")) and values["min_freq"] > values["max_freq"]:
        wrong.append("min_freq must not pass max_freq")
    return wrong


def event(data: str, name: str | None = None) -> str:
    """One server-sent event: every line of the data, then an empty line."""
    head = f"event: {name}\n" if name else ""
    return head + "".join(f"data: {line}\n" for line in re.split(r"\r\n|\r|\n", data)) + "\n"

"""Queries of domain terms, alias edges, explained scores and judge answers; each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _asked, _docs, _said, _vectors
from .catalog_more import _FIVE, _SAID, _index, _questions
from .catalog_sql import _TOKEN
from .catalog_sql import SQL as _SQL
from .functions import text as T
from .operators import lexical, search, terms
from .session import table

H1 = ["Army Rule", "detachment rules", "Unit Data", "faction", "载具", "技能"]


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def _chunks(s, d):
    """Documents as chunks: the first heading by number, the others of source and language."""
    x = table(s, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    heads = [_pick(H1, F.col("doc_id")).alias("h1"), F.concat(F.lit("步兵 "), "source", F.lit(" (alias, "), "lang", F.lit(")")).alias("h2"), F.concat(F.lit("近战 "), "lang").alias("h3")]
    return x.select("doc_id", "text", *heads, F.when(F.col("doc_id") % 2 == 0, "corerule").alias("content_type"))


def heading_terms(s, d):
    return terms.heading_terms(_chunks(s, d))


def chunk_terms(s, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 先攻 先攻 连击"))).otherwise(F.col("text"))
    return terms.chunk_terms(_chunks(s, d).withColumn("text", text))


def term_families(s, d):
    found = terms.family_terms(_docs(s, d))
    return found.groupBy("category", "term").agg(F.count(F.lit(1)).alias("n"))


def heading_tokens(s, d):
    """Headings of each document's source and of its length and number in CJK digits."""
    digits = lambda c: F.translate(F.col(c).cast("string"), "0123456789", "零一二三四五六七八九")
    h = F.concat(digits("n_chars"), F.lit("字 A,"), "source", F.lit("/第"), digits("doc_id"), F.lit("号"))
    return table(s, d, "documents").where("source is not null and n_chars is not null").select("doc_id", F.array_join(terms.heading_tokens(h), "|").alias("tokens"))


def heading_categories(s, d):
    """Headings by what each text holds and by its length."""
    h1 = F.when(F.col("n_chars") % 3 == 0, "核心规则").when(F.col("n_chars") % 3 == 1, "派系").otherwise("x")
    h2 = F.when(F.col("text").contains("shth"), "近战").when(F.col("text").contains(" de "), "人物").otherwise("y")
    return table(s, d, "documents").where("text is not null and n_chars is not null").select("doc_id", terms.heading_category(h1, h2).alias("category"))


def term_removal(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.length(terms.without_term(F.col("text"), F.lit("the"))).alias("chars"))


def alias_edges(s, d):
    """Nodes named by number, whose aliases are their own name, the next node's and twice the double's."""
    n = F.col("doc_id")
    names = F.transform(F.array(n, n + 1, n * 2, n * 2), lambda x: F.concat(F.lit("n"), x.cast("string")))
    return terms.alias_edges(_vectors(s, d).select(n.alias("node_id"), F.concat(F.lit("n"), n.cast("string")).alias("name"), names.alias("aliases")))


def explained_hits(s, d):
    return terms.explained(search.five_parts(_index(s, d), _questions(s, d)), ["heading", "bm25", "content", "metadata"], ["dense"])


def sparse_diagnostics(s, d):
    return terms.sparse_diagnostics(lexical.weights(_docs(s, d)))


def analyzer_tokens(s, d):
    return _asked(s, d).select("query_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


def entities_by_position(s, d):
    """Passages with the labels of the vectors of even numbers, by position."""
    v = _vectors(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("position"), F.col("label").alias("entity"))
    return terms.zip_entities(_asked(s, d).select(F.col("query_id").alias("position")), v)


def _answers(s, d):
    """Messages in the forms of a judge's answer, by turn."""
    text, form = F.col("text"), F.col("turn") % 5
    blank = F.lit(" ")
    out = F.when(form == 0, F.to_json(F.struct(text.alias("text")))).when(form == 1, F.to_json(F.struct(F.array(text, blank, F.lit("end")).alias("statements"))))
    out = out.when(form == 2, F.to_json(F.struct(F.lit(1).alias("verdict"), text.alias("reason")))).when(form == 3, F.to_json(F.struct(F.lit("yes").alias("verdict"))))
    return table(s, d, "conversations").where("trim(text) <> '' and not contains(text, '\"text\"')").select("conv_id", "turn", text, out.otherwise(text).alias("answer"))


def judge_texts(s, d):
    return _answers(s, d).select("conv_id", "turn", terms.judge_text(F.col("answer")).alias("judged"))


def model_entities(s, d):
    """Answers that name each question as an entity, of a type by its length, and a blank one; some are no JSON."""
    kind = _pick(["unit", "place", "weapon"], F.length("text"))
    answer = F.to_json(F.array(F.struct(F.concat(F.lit(" "), "text").alias("text"), kind.alias("type")), F.struct(F.lit(" ").alias("text"), F.lit("unit").alias("type"))))
    found = _said(s, d).where("trim(text) <> ''").select("conv_id", "turn", terms.checked_entities(F.when(F.col("turn") % 4 != 0, answer).otherwise("none"), ["unit", "weapon"]).alias("found"))
    return found.select("conv_id", "turn", F.explode("found").alias("e")).select("conv_id", "turn", F.col("e.text").alias("term"), F.col("e.type").alias("type"), F.col("e.confidence").alias("confidence"))


_CHUNKS = "c as (select doc_id, text, doc_id % 6 kind, coalesce(source, 'none') source, coalesce(lang, 'none') lang from documents)"
_HEADS = f"""{_CHUNKS}, ht as (
 select doc_id, 'mechanics' category, unnest(['步兵 ( )', '近战']) term from c where kind = 0 union
 select doc_id, 'detachments', '步兵 ( )' from c where kind = 1 union
 select doc_id, 'units', unnest(['步兵 ' || source, 'alias', lang, '近战 ' || lang]) from c where kind = 2 union
 select doc_id, 'factions', '步兵 ( )' from c where kind = 3 union
 select doc_id, 'units', unnest(['步兵 ' || source, 'alias', lang]) from c where kind >= 4 union
 select doc_id, 'weapons', '近战' from c where kind >= 4)"""
_MECHANICS = "select doc_id, 'mechanics' category, unnest(list_distinct(regexp_extract_all(case when doc_id % 3 = 0 then text || ' 先攻 先攻 连击' else text end, '{0}'))) term from documents where doc_id % 2 = 0".format(terms.FAMILIES["mechanics"])
_ANSWERS = """a as (select conv_id, turn, text, case turn % 5 when 0 then text when 1 then text || chr(10) || 'end' when 2 then text when 3 then 'yes'
 else trim(regexp_replace(text, '[\\n\\r]', ' ', 'g'), ' ') end judged from conversations where trim(text, ' ') <> '' and not contains(text, '"text"'))"""

SQL = {
    "heading_terms": f"with {_HEADS} select * from ht",
    "chunk_terms": f"with {_HEADS}, m as ({_MECHANICS}) select category, term, count(*) n from (select * from ht union select * from m) group by all",
    "term_families": "select category, term, count(*) n from (" + " union all ".join(f"select doc_id, '{n}' category, unnest(list_distinct(regexp_extract_all(text, '{p}'))) term from documents" for n, p in terms.FAMILIES.items()) + ") group by all",
    "heading_tokens": "select doc_id, translate(n_chars::varchar, '0123456789', '零一二三四五六七八九') || '字|第' || translate(doc_id::varchar, '0123456789', '零一二三四五六七八九') || '号' tokens from documents where source is not null and n_chars is not null",
    "heading_categories": "select doc_id, case when contains(text, 'shth') then 'weapons' when contains(text, ' de ') then 'units' when n_chars % 3 = 0 then 'mechanics' when n_chars % 3 = 1 then 'factions' else 'general' end category from documents where text is not null and n_chars is not null",
    "term_removal": "select doc_id, length(regexp_replace(text, '\\bthe\\b', '', 'g')) chars from documents where text is not null",
    "alias_edges": "with p as (select vec_id node_id, unnest([vec_id + 1, vec_id * 2]) alias_id from embeddings) select distinct p.* from p join embeddings e on e.vec_id = p.alias_id where node_id <> alias_id",
    "explained_hits": f"with {_FIVE}, top as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from five qualify rank <= 10) select query_id, doc_id, score, round(heading + bm25 + content + metadata, 6) text_similarity, round(dense, 6) vector_similarity from top",
    "sparse_diagnostics": _SQL["sparse_top10"].split(", x as (")[0].replace("round(idf * tf * 2.5", "(idf * tf * 2.5").replace(", 9) w from", ") w from") + " select doc_id, count(*) terms, round(min(w), 6) \"least\", round(max(w), 6) most, round(avg(w), 6) mean from w where w > 0 group by doc_id",
    "analyzer_tokens": f"select item_id query_id, array_to_string(regexp_extract_all(lower(text), '{_TOKEN}'), ' ') tokens from benchmark",
    "entities_by_position": "select item_id as \"position\", e.label entity from benchmark left join embeddings e on e.vec_id = item_id and e.vec_id % 2 = 0",
    "judge_texts": f"with {_ANSWERS} select conv_id, turn, judged from a",
    "model_entities": f"select conv_id, turn, trim(text, ' ') term, case length(text) % 3 when 0 then 'unit' else 'weapon' end as type, 0.85::double confidence from {_SAID} where trim(text, ' ') <> '' and turn % 4 <> 0 and length(text) % 3 <> 1",
}

_NAMES = """heading_terms chunk_terms term_families heading_tokens heading_categories term_removal alias_edges explained_hits sparse_diagnostics
analyzer_tokens entities_by_position judge_texts model_entities""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}

"""Further queries: search engines, ingestion, query processing, features, answer metrics; each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _asked, _bio, _dense, _docs, _said, _three_runs, _vector_queries, _vectors, bm25_topk, knn_exact, uncertainty_scores
from .catalog_sql import _BIO, _BM25, _DENSE10, _KNN, _LUCENE, _TOKEN, _UNC, _W, SQL as _SQL, _tok
from .functions import text as T
from .operators import chunking, evaluation, fields, ingest, learning, lexical, querying, ranking, search, sequence, vocabulary
from .session import table

WORDS = ["the", "of", "what"]
KEYS = {"list": ["the", "of", "list"], "rule": ["und", "la"]}
RELATED, SYNONYMS, CONTEXT = {"the": "that those", "la": "el"}, {"of": "from"}, {"the": "now here", "der": "jetzt"}


# -- an index table: headings and metadata derived from the documents --------------------------------------------------


def _index(s, d):
    """All documents, with the vector of their number if there is one; source, language and length as headings and metadata."""
    x = table(s, d, "documents").select("doc_id", "text", "source", "lang", "n_chars").join(_vectors(s, d).select("doc_id", "embedding"), "doc_id", "left")
    heads = {"h1": "source", "h2": "lang", "section_heading": "lang", "faction": "source", "chunk_type": "lang"}
    none = {c: F.lit(None).cast("string") for c in ("h4", "h5", "h6", "sub_section", "content_type")}
    return x.select("doc_id", "text", "embedding", *[F.col(v).alias(k) for k, v in heads.items()], F.col("n_chars").cast("string").alias("h3"), *[v.alias(k) for k, v in none.items()])


def _questions(s, d):
    """Passages with the vector of their number."""
    return _asked(s, d).join(_vectors(s, d).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")


def hybrid_five(s, d):
    return search.five_parts(_index(s, d), _questions(s, d))


def search_dense(s, d):
    return search.dense(_index(s, d), _questions(s, d))


def search_fused(s, d):
    return search.rank_fusion(_index(s, d), _questions(s, d))


def search_dispatch(s, d):
    """Passages with intents in turn, and how many results each engine gives."""
    names = F.array(*[F.lit(x) for x in ("query", "rule", "list", "unknown")])
    asked = _questions(s, d).withColumn("intent", F.get(names, F.pmod("query_id", F.lit(4)).cast("int")))
    return search.dispatch(_index(s, d), asked).groupBy("engine").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("results"))


def entity_search(s, d):
    q = _questions(s, d).withColumn("entity", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return search.by_entity(_index(s, d), q)


def smart_filters(s, d):
    f = search.smart_filter(F.col("text"))
    return _said(s, d).select("conv_id", "turn", *[v.alias(k) for k, v in f.items()])


def text_quality(s, d):
    t = F.col("text")
    return _said(s, d).select("conv_id", "turn", search.quality_flags(t).alias("good"), search.long_enough(t).alias("long"), F.length(search.cleaned_query(t)).cast("long").alias("chars"))


def fuzzy_words(s, d):
    terms = lexical.corpus(_docs(s, d)).where("term is not null and freq >= 20").select("term")
    words = _asked(s, d).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").count().where("count >= 5 and length(word) >= 3")
    return search.fuzzy_terms(terms, words)


def ranked_runs(s, d):
    return search.runs(bm25_topk(s, d)).select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


# -- ingestion -----------------------------------------------------------------------------------------------------------


def _markdown(s, d):
    """Documents as Markdown: source and language as headings of level 1 and 2, and for every third a section of level 3 with a block."""
    x = table(s, d, "documents").where("text is not null")
    deep = F.when(F.col("doc_id") % 3 == 0, F.lit("\n### Part\nfirst line\n**Abilities:** run\nmore\n**Keywords:** one\n\n#### Deep\nlost")).otherwise("")
    text = F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n## "), F.coalesce("lang", F.lit("none")), F.lit("\n"), F.replace("text", F.lit("#"), F.lit("")), deep)
    return x.select("doc_id", text.alias("text"))


def _sections(s, d):
    return chunking.sections(chunking.lines(_markdown(s, d)))


def chunk_strategy(s, d):
    return ingest.strategy(_sections(s, d))


def chunk_records(s, d):
    rows = ingest.chunk_rows(ingest.blocks(_sections(s, d)))
    return rows.select("doc_id", "chunk_type", "sub_section", F.length("text").cast("long").alias("chars"), "h1", "h2", "h3", "section_heading")


def structure_levels(s, d):
    return chunking.structure_report(chunking.lines(_markdown(s, d))).select("doc_id", "headings", F.col("max_depth").cast("long").alias("max_depth"), "jumps", "repeated")


def split_sentences(s, d):
    pieces = ingest.split_budget(F.replace("text", F.lit("."), F.lit("。")), 64)
    return _docs(s, d).where("text is not null").select("doc_id", F.explode(pieces).alias("p")).groupBy("doc_id").agg(F.sum((F.size(T.words(F.col("p"))) > 64).cast("long")).alias("over"), F.sum(F.size(T.words(F.col("p")))).alias("words"))


def sparse_records(s, d):
    w = lexical.weights(_docs(s, d))
    made = ingest.vector_records(_index(s, d), _vectors(s, d), ingest.sparse_vectors(w))
    return made.select(F.col("id").alias("doc_id"), F.size("values").cast("long").alias("dim"), F.col("metadata")["faction"].alias("faction"), F.greatest(F.size("sparse_values.indices"), F.lit(0)).cast("long").alias("terms"), F.round(F.array_max("sparse_values.values"), 5).alias("heaviest"))


def index_rows(s, d):
    x = ingest.index_documents(table(s, d, "documents").select("doc_id", "text", F.col("source").alias("faction"), F.col("lang").alias("h1"), F.col("n_chars").alias("chunk_index")))
    return x.groupBy("chunk_type", "faction", "h1").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").cast("long").alias("last"))


def upload_status(s, d):
    """Batches of at most 100 rows to a sink that keeps nothing."""
    return ingest.send(_vectors(s, d).select("doc_id"), lambda rows: None).agg(F.sum("n").alias("sent"), F.sum((~F.col("ok")).cast("long")).alias("failed"), (F.max("n") <= 100).alias("bounded"))


def raw_store(s, d):
    x = _docs(s, d)
    return ingest.merge_texts(x.where("doc_id % 2 = 1"), x.where("doc_id % 2 = 0")).select("doc_id")


def match_all_sample(s, d):
    """A sample of a stated size, by id."""
    return _docs(s, d).orderBy("doc_id").limit(10).select("doc_id")


# -- query processing ------------------------------------------------------------------------------------------------------


def expand_methods(s, d):
    return querying.expand_methods(_asked(s, d), RELATED, SYNONYMS, CONTEXT).select("query_id", F.col("variant").cast("long").alias("variant"), "text", "method")


def expand_suffixes(s, d):
    return querying.processor("expand")(_asked(s, d)).select("query_id", F.col("variant").cast("long").alias("variant"), "text")


def annotate_intents(s, d):
    return _said(s, d).select("conv_id", "turn", querying.annotated_intent(F.col("text")).alias("intent"))


def intent_decisions(s, d):
    """Questions through the vocabulary gate; confidences are derived from their length."""
    q = _said(s, d).withColumn("query_id", F.col("conv_id") * 100 + F.col("turn"))
    terms = s.createDataFrame([("THE ",), ("und",), ("que la",)], "term string")
    c = F.round((F.length("text") % 10) / 10.0, 6)
    known = querying.gate(q, terms).withColumns({"intent": querying.intent(F.col("text")), "confidence": c})
    return querying.decide(known).select("query_id", "known", "intent", F.col("reply").isNotNull().alias("canned"))


def weight_rewrite(s, d):
    lines = _asked(s, d).select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.select(F.concat_ws(" ", "t", F.col("n").cast("string")).alias("value"))
    return vocabulary.rewrite_weights(lines, s.createDataFrame([("the", 1.5), ("of", 2.25)], "term string, factor double"))


def term_category(s, d):
    v = table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("category"), F.explode(T.tokens(F.col("text"))).alias("term"))
    asked = _asked(s, d).select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return vocabulary.category_of(asked, v.distinct(), ["es", "de", "fr", "en"])


def vocab_save(s, d):
    x = _docs(s, d)
    one = lambda c: lexical.term_counts(x.where(c)).groupBy("term").agg(F.sum("tf").alias("frequency")).select(F.lit("all").alias("category"), "term", "frequency")
    return vocabulary.save(one("doc_id % 2 = 0"), one("doc_id % 2 <> 0")).where("frequency >= 5")


def synonym_expansion(s, d):
    groups = s.createDataFrame([(1, "the"), (1, "la"), (1, "der"), (2, "of"), (2, "de"), (2, "la")], "line long, term string")
    t = _asked(s, d).select(F.col("query_id").alias("key"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return vocabulary.expand_synonyms(t, groups).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("term") != F.col("given")).cast("long")).alias("added"))


def dictionary_terms(s, d):
    return vocabulary.frequency_dictionary(lexical.corpus(_docs(s, d))).where("freq >= 20")


def entity_report(s, d):
    from .catalog import entity_match

    r = vocabulary.grouped_entities(entity_match(s, d))
    return r.select("doc_id", "type", F.array_join("names", ",").alias("names"))


# -- features, learning ----------------------------------------------------------------------------------------------------


def advanced_features(s, d):
    return _said(s, d).select("conv_id", "turn", *[v.alias(k) for k, v in learning.advanced_features(F.col("text"), KEYS).items()])


def structure_features(s, d):
    return _said(s, d).select("conv_id", "turn", *[v.alias(k) for k, v in learning.structure_features(F.col("text"), WORDS).items()])


def feature_fusion(s, d):
    """Two slices of each vector, joined by weight, by products and by attention; digests of the arrays."""
    a, b = F.slice("embedding", 1, 3), F.slice("embedding", 4, 3)
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), 5)
    return _vectors(s, d).select("doc_id", total(learning.weighted_concat([a, b], [2.0, 0.5])).alias("joined"), total(learning.interaction(a, b)).alias("products"), total(learning.attention([a, b])).alias("attended"))


def slot_context(s, d):
    """One-hot labels of the tokens before, of and after each token."""
    from pyspark.sql import Window as W

    w, names = W.partitionBy("sent_id").orderBy("pos"), ["O", "B-NAME", "I-NAME"]
    x = _bio(s, d).withColumns({"before": F.lag("label").over(w), "after": F.lead("label").over(w)})
    hot = F.concat(*[learning.one_hot(F.col(c), names) for c in ("before", "label", "after")])
    return x.select("sent_id", F.col("pos").cast("long").alias("pos"), F.array_join(F.transform(hot, lambda v: v.cast("int").cast("string")), "").alias("hot"))


def review_decisions(s, d):
    u = uncertainty_scores(s, d)
    done = u.where("event_id % 4 = 0").select("event_id")
    return learning.reviewed(u, done, "event_id").select("event_id", learning.trust(F.col("uncertainty")).alias("action"), learning.confidence_class(F.col("confidence")).alias("level"))


def dataset_report(s, d):
    x = table(s, d, "conversations").select(F.col("role").alias("label"), "text")
    return learning.dataset_report(x.where("label is not null"))


# -- evaluation --------------------------------------------------------------------------------------------------------------


def score_moments(s, d):
    return evaluation.score_moments(knn_exact(s, d))


def answer_metrics(s, d):
    """An assistant's turn as answer, the turn before as reference."""
    c = table(s, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.tokens(F.col("text")).alias("answer"))
    r = c.where("role = 'user'").select("conv_id", "turn", T.tokens(F.col("text")).alias("reference"))
    return evaluation.answer_metrics(a.join(r, ["conv_id", "turn"]))


def answer_means(s, d):
    return evaluation.safe_means(answer_metrics(s, d), ["precision", "recall", "f1", "bigram"])


def sample_validity(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("role") == "user", F.col("text")).alias("reference"), F.when(F.col("turn") > 0, F.col("text")).alias("answer"), F.when(F.col("turn") % 2 == 0, F.array("text")).alias("contexts"))
    return evaluation.fill_samples(c).groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("contexts")).alias("contexts"))


def vector_quadrants(s, d):
    return evaluation.quadrants(_vectors(s, d).select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")))


def fallback_original(s, d):
    few = bm25_topk(s, d).where("rank <= 3")
    return ranking.top_up_variant(few, 8, "original")


def mmr_relevance(s, d):
    q = _vector_queries(s, d).drop("query_label")
    return ranking.query_relevance(ranking.knn(_vectors(s, d).select("doc_id", "embedding"), q, 5).join(_vectors(s, d).select("doc_id", "embedding"), "doc_id"), q).select("query_id", "doc_id", "score")


# -- SQL ---------------------------------------------------------------------------------------------------------------------

_IX = f"""ix as (select d.doc_id, d.text, e.embedding, d.source h1, d.lang h2, d.n_chars::varchar h3, d.lang section_heading, d.source faction, d.lang chunk_type
 from documents d left join embeddings e on e.vec_id = d.doc_id), iq as (select b.item_id query_id, b.text, e.embedding qv from benchmark b join embeddings e on e.vec_id = b.item_id)"""
_WEIGHTS = {k: v for k, v in (fields.HEADING_WEIGHTS | fields.METADATA_WEIGHTS | {"text": 1.0}).items() if k in ("h1", "h2", "h3", "section_heading", "faction", "chunk_type", "text")}
_IXF = f"""fd as ({' union all '.join(f"select doc_id, '{f}' field, {w}::double boost, regexp_extract_all(lower({f}), '{_TOKEN}') t from ix where {f} is not null" for f, w in _WEIGHTS.items())}),
fl as (select *, len(t) dl from fd where len(t) > 0), fs as (select field, count(*) n, avg(dl) avgdl from fl group by all),
ft as (select doc_id, field, boost, dl, term, count(*) tf from (select doc_id, field, boost, dl, unnest(t) term from fl) group by all), fdf as (select field, term, count(*) df from ft group by all),
fq as (select query_id, term, count(*) qtf from (select query_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) term from iq) group by all),
fsc as (select query_id, doc_id, field, sum(qtf * boost * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) score from ft join fdf using (field, term) join fs using (field) join fq using (term) group by all),
lx as (select query_id, doc_id, max(score) filter (where field in ('h1', 'h2', 'h3')) hb, sum(score) filter (where field in ('h1', 'h2', 'h3')) ht, max(score) filter (where field in ('section_heading', 'faction', 'chunk_type')) metadata, max(score) filter (where field = 'text') bm25 from fsc group by all)"""
_DOTQ = "round(list_dot_product(ix.embedding::double[], iq.qv::double[]), 6)"
_NEAR = f"near as (select query_id, doc_id, {_DOTQ} score, row_number() over (partition by query_id order by {_DOTQ} desc, doc_id) rank from ix, iq where query_id <> doc_id and ix.embedding is not null qualify rank <= 30)"
_SCALE = "case when {0} is null then 0.0::double when min({0}) over q = max({0}) over q then 0.5::double else ({0} - min({0}) over q) / (max({0}) over q - min({0}) over q) end"
_FIVE = f"""{_IX}, {_IXF}, {_NEAR}, lb as (select query_id, doc_id, hb + 0.3::double * (ht - hb) heading, bm25, bm25 * b.boost as content, metadata from lx join (select query_id, case when len({_W.format('text')}) > 20 then 1.4::double else 1.2::double end boost from iq) b using (query_id)),
ev as (select query_id, doc_id, heading, bm25, content, metadata, near.score dense from lb full join near using (query_id, doc_id)),
sc as (select query_id, doc_id, {', '.join(f"round({_SCALE.format(p)}, 6) {p}" for p in search.PARTS)} from ev window q as (partition by query_id)),
five as (select *, round((heading + bm25 + content + metadata + dense) / 5.0::double, 6) score from sc)"""
_RERANK = f"rr as (select near.query_id, near.doc_id, list_distinct(list_transform({_W.format('iq.text')}, lambda w: lower(w))) a, list_distinct(list_transform({_W.format('ix.text')}, lambda w: lower(w))) b from near join ix using (doc_id) join iq on iq.query_id = near.query_id where length(trim(ix.text)) >= 10), rs as (select query_id, doc_id, case when len(list_distinct(list_concat(a, b))) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) else 0.0 end score from rr)"
# rank fusion: the window and constant that the engine derives
_FUSED = f"""dt as (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) term from ix), dtf as (select doc_id, term, count(*) tf from dt group by all), ddl as (select doc_id, sum(tf) dl from dtf group by all), dn as (select count(*) n, avg(dl) avgdl from ddl),
 ddf as (select term, count(*) df from dtf group by all), draw as materialized (select term, ln(n - df + 0.5) - ln(df + 0.5) r from ddf, dn), dm as (select avg(r) m from draw), didf as (select term, case when r < 0 then 0.25 * m else r end idf from draw, dm),
 dq as (select query_id, term, count(*) qtf from (select query_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) term from iq) group by all),
 dsc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from dq join dtf using (term) join didf using (term) join ddl using (doc_id), dn group by all),
 dlx as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) rank from dsc qualify rank <= 30),
 dfu as (select query_id, doc_id, round(sum(1.0::double / (20 + rank)), 6) score from (select query_id, doc_id, rank from dlx union all select query_id, doc_id, rank from near) group by all),
 fu as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from dfu qualify rank <= 10)"""
_SAID = "(select conv_id, turn, text from conversations where role = 'user')"
_ANY = lambda t, ws: "(" + " or ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_PAIR = f"ap as (select a.conv_id, a.turn - 1 turn, regexp_extract_all(lower(a.text), '{_TOKEN}') x, regexp_extract_all(lower(r.text), '{_TOKEN}') y from conversations a join conversations r on r.conv_id = a.conv_id and r.turn = a.turn - 1 where a.role = 'assistant' and r.role = 'user'), ad as (select *, list_distinct(x) dx, list_distinct(y) dy, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) bx, list_distinct(list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1])) byy from ap)"
_AM = f"{_PAIR}, am as (select conv_id, turn, (x = y)::int::double exact, case when len(dx) > 0 then round(len(list_intersect(dx, dy)) / len(dx), 6) else 0 end \"precision\", case when len(dy) > 0 then round(len(list_intersect(dx, dy)) / len(dy), 6) else 0 end recall, case when len(dx) + len(dy) > 0 then round(2 * len(list_intersect(dx, dy)) / (len(dx) + len(dy)), 6) else 0 end f1, case when len(bx) > 0 then round(len(list_intersect(bx, byy)) / len(bx), 6) else 0 end bigram, case when len(y) > 0 then round(len(x) / len(y), 6) else 0 end ratio from ad)"
_VOC = lambda c: f"(select term, sum(tf) f from (select doc_id, term, count(*) tf from (select doc_id, {_tok('text')} term from documents where {c}) group by all) group by all)"
_TOTAL = "case when doc_id % 3 = 0 then {0} else {1} end"

SQL = {
    "hybrid_five": f"with {_FIVE} select *, row_number() over (partition by query_id order by score desc, doc_id) rank from five qualify rank <= 10",
    "search_fused": f"with {_IX}, {_NEAR}, {_FUSED} select query_id, doc_id, score, rank from fu",
    "search_dispatch": f"""with {_FIVE}, {_RERANK}, {_FUSED}, five_r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) rank from five qualify rank <= 10), dense_r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) rank from rs qualify rank <= 10),
 ev2 as (select 'rrf' engine, query_id from fu where query_id % 4 in (0, 2) union all select 'pipeline', query_id from five_r where query_id % 4 = 1 union all select 'dense', query_id from dense_r where query_id % 4 = 3) select engine, count(distinct query_id) queries, count(*) results from ev2 group by all""",
    "fuzzy_words": f"with t as (select unnest(regexp_extract_all(lower(text), '{_TOKEN}')) term from documents), v as (select term from t group by term having count(*) >= 20), w as (select term word, case when length(term) <= 5 then 1 else 2 end most from (select unnest(regexp_extract_all(lower(text), '{_TOKEN}')) term from benchmark) where length(term) >= 3 group by term having count(*) >= 5) select word, term, levenshtein(translate(word, 'äöüßéèêçàùâîôûëïñáíóú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(term, 'äöüßéèêçàùâîôûëïñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')) distance from w, v where abs(length(word) - length(term)) <= most and levenshtein(translate(word, 'äöüßéèêçàùâîôûëïñáíóú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(term, 'äöüßéèêçàùâîôûëïñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')) <= most",
    "intent_decisions": f"select query_id, known, intent, intent in ('non_domain', 'unknown') canned from (select conv_id * 100 + turn query_id, regexp_matches(lower(text), 'the |und|que la') known, case when not regexp_matches(lower(text), 'the |und|que la') then 'non_domain' when round(length(text) % 10 / 10.0, 6) < 0.5 then 'query' else " + _SQL["intent_route"].split("select conv_id, turn, ")[1].split(" intent from")[0] + f" end intent from {_SAID})",
    "search_dense": f"with {_IX}, {_NEAR}, {_RERANK} select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from rs qualify rank <= 10",
    "entity_search": f"with {_IX}, hs as (select distinct doc_id, unnest([h1, h2, h3]) entity from ix) select query_id, ix.doc_id, {_DOTQ} score, row_number() over (partition by query_id order by {_DOTQ} desc, ix.doc_id) rank from iq join hs on hs.entity = 'src' || (query_id % 20) join ix using (doc_id) where ix.embedding is not null qualify rank <= 10",
    "smart_filters": f"select conv_id, turn, case when {_ANY('text', search.RULE_WORDS)} then 'corerule' end content_type, case when not {_ANY('text', search.RULE_WORDS)} and {_ANY('text', search.UNIT_WORDS)} then 'unit_data' end chunk_type from {_SAID}",
    "text_quality": f"select conv_id, turn, length(trim(text, ' ')) between 2 and 200 and regexp_matches(trim(text, ' '), '[\\p{{L}}\\p{{N}}]') good, length(trim(text, ' ')) >= 10 as long, least(length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), 200) chars from {_SAID}",
    "ranked_runs": f"{_BM25} select query_id, string_agg(doc_id, ',' order by rank) doc_ids from run group by all",
    "chunk_strategy": "select doc_id, case when doc_id % 3 = 0 then 'logical_blocks' else 'v3_compatible' end strategy from documents where text is not null",
    "chunk_records": """with x as (select doc_id, coalesce(source, 'none') h1, coalesce(lang, 'none') h2, replace(text, '#', '') t from documents where text is not null),
 b as (select doc_id, h1, h2, '' h3, 'basic' sub_section, h2 section_heading, h1 || '-' || h2 chunk_type, t from x where trim(t) <> '' union all
 select doc_id, h1, h2, 'Part', v.s, 'Part', h1 || '-' || h2 || '-Part', v.t from x, (values ('basic', 'first line'), ('Abilities', '**Abilities:** run' || chr(10) || 'more'), ('Keywords', '**Keywords:** one')) v(s, t) where doc_id % 3 = 0)
 select doc_id, chunk_type, sub_section, length(chunk_type) + 1 + length(regexp_replace(t, '^\\s+', '')) chars, h1, h2, h3, section_heading from b""",
    "structure_levels": f"select doc_id, {_TOTAL.format(4, 2)}::bigint headings, {_TOTAL.format(4, 2)}::bigint max_depth, 0::bigint jumps, (coalesce(source, 'none') = coalesce(lang, 'none'))::bigint repeated from documents where text is not null",
    "sparse_records": _SQL["sparse_top10"].split(", x as (")[0].replace("round(idf * tf * 2.5", "(idf * tf * 2.5").replace(", 9) w from", ") w from") + ", sw as (select doc_id, count(*) terms, round(max(w), 5) heaviest from w where w > 0 group by all) select d.doc_id, len(e.embedding) dim, coalesce(d.source, 'unknown') faction, coalesce(terms, 0) terms, heaviest from documents d join embeddings e on e.vec_id = d.doc_id left join sw on sw.doc_id = d.doc_id",
    "index_rows": "select 'default' chunk_type, coalesce(source, '') faction, coalesce(lang, '') h1, count(*) n, max(coalesce(n_chars, 0)) as last from documents group by all",
    "upload_status": "select count(*) sent, 0::bigint failed, true as bounded from embeddings",
    "raw_store": "select first(doc_id order by (doc_id + 1) % 2, doc_id) doc_id from documents where text is not null group by text",
    "match_all_sample": "select doc_id from documents order by doc_id limit 10",
    "expand_methods": "with v as (select item_id query_id, unnest([{variant: 0, text: text, method: 'original'}, {variant: 1, text: case when contains(text, 'the') then text || ' that those' when contains(text, 'la') then text || ' el' end, method: 'related'}, {variant: 2, text: case when contains(text, 'of') then replace(text, 'of', 'of from') end, method: 'synonyms'}, {variant: 3, text: case when contains(text, 'the') then text || ' now here' when contains(text, 'der') then text || ' jetzt' end, method: 'context'}]) x from benchmark) select query_id, x.variant::bigint as variant, x.text as text, x.method as method from v where x.text is not null",
    "expand_suffixes": "select item_id query_id, unnest(range(0, 3)) as variant, unnest([text, text || ' details', text || ' related']) as text from benchmark",
    "annotate_intents": "select conv_id, turn, case " + " ".join(f"when {_ANY('lower(text)', ws)} then '{n}'" for n, ws in querying.ANNOTATION_WORDS.items()) + f" else 'query' end intent from {_SAID}",
    "weight_rewrite": f"select term || ' ' || trunc(count(*) * case term when 'the' then 1.5 when 'of' then 2.25 else 1 end)::bigint || ' n' as value from (select {_tok('text')} term from benchmark) group by term",
    "term_category": f"with v as (select distinct lang, {_tok('text')} term from documents where lang is not null), p as (select term, first(lang order by case lang when 'es' then 1 when 'de' then 2 when 'fr' then 3 when 'en' then 4 else 5 end, lang) category from v group by all) select distinct q.term, p.category from (select {_tok('text')} term from benchmark) q left join p using (term)",
    "vocab_save": f"select 'all' category, term, case when n.f is null then o.f when o.f is null then n.f else o.f + 1 end::bigint frequency from {_VOC('doc_id % 2 <> 0')} o full join {_VOC('doc_id % 2 = 0')} n using (term) where frequency >= 5",
    "synonym_expansion": f"with g(line, term) as (values (1, 'the'), (1, 'la'), (1, 'der'), (2, 'of'), (2, 'de'), (2, 'la')), p as (select distinct a.term, b.term mate from g a join g b using (line) where a.term <> b.term), t as (select distinct item_id as key, {_tok('text')} term from benchmark), e as (select key, term, term given from t union select key, mate, t.term from t join p using (term)) select key, count(*) n, sum((term <> given)::int)::bigint added from e group by all",
    "dictionary_terms": f"with t as (select doc_id, {_tok('text')} term from documents) select term, count(*) freq, count(distinct doc_id) df, round(ln(1 + count(distinct doc_id)), 6) weight from t group by term having count(*) >= 20",
    "entity_report": _SQL["entity_match"].replace("select * from ent", "select doc_id, type, string_agg(distinct name, ',' order by name) names from ent group by all"),
    "advanced_features": f"select conv_id, turn, length(text) chars, len({_W.format('text')}) words, round(len({_W.format('text')}) / greatest(length(text), 1), 6) density, len(regexp_extract_all(text, '[?？]')) questions, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) digits, case when len({_W.format('text')}) > 0 then round(len(list_distinct({_W.format('text')})) / len({_W.format('text')}), 6) else 0 end variety, " + ", ".join("round((" + " + ".join(f"contains(lower(text), '{k}')::int" for k in ks) + f") / {len(ks)}.0::double, 6) has_{n}" for n, ks in KEYS.items()) + f" from {_SAID}",
    "structure_features": "select conv_id, turn, " + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)} n_{w}, case when contains(lower(text), '{w}') then round((instr(lower(text), '{w}') - 1) / length(text), 6) else -1.0 end at_{w}" for w in WORDS) + f" from {_SAID}",
    "feature_fusion": "with v as (select vec_id doc_id, embedding[1:3]::double[] a, embedding[4:6]::double[] b from embeddings), s as (select *, exp(list_sum(list_transform(a, lambda x: abs(x))) / 3) ea, exp(list_sum(list_transform(b, lambda x: abs(x))) / 3) eb from v) select doc_id, round(2 * list_sum(a) + 0.5::double * list_sum(b), 5) joined, round(list_sum(a) * list_sum(b), 5) products, round((ea * list_sum(a) + eb * list_sum(b)) / (ea + eb), 5) attended from s",
    "slot_context": f"with {_BIO}, w as (select sent_id, pos, lag(label) over w b, label l, lead(label) over w a from bio window w as (partition by sent_id order by pos)) select sent_id, pos, " + " || ".join(f"coalesce(({c} = '{n}')::int, 0)" for c in "bla" for n in ("O", "B-NAME", "I-NAME")) + " hot from w",
    "review_decisions": f"with {_UNC} select event_id, case when uncertainty >= 0.6 then 'review' when uncertainty <= 0.3 then 'automatic' else 'check' end \"action\", case when confidence >= 0.8 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as level from unc where event_id % 4 <> 0",
    "dataset_report": "select role as label, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(avg(length(text)), 6) mean_length, count(distinct text) as distinct from conversations where role is not null group by role",
    "score_moments": f"{_KNN} select round(avg(score), 6) mean, round(stddev_pop(score), 6) deviation, min(score) least, max(score) most, round(quantile_cont(score, 0.2), 6) low from knn",
    "answer_metrics": f"with {_AM} select * from am",
    "answer_means": f"with {_AM} select round(avg(\"precision\"), 6) \"precision\", round(avg(recall), 6) recall, round(avg(f1), 6) f1, round(avg(bigram), 6) bigram from am",
    "sample_validity": "with v as (select trim(coalesce(text, ''), ' ') <> '' and role = 'user' and turn > 0 and turn % 2 = 0 ok, (turn % 2 = 0)::int c from conversations) select coalesce(ok, false) as valid, count(*) n, sum(c)::bigint contexts from v group by 1",
    "vector_quadrants": "select case when embedding[1] >= 0 and embedding[2] >= 0 then 1 when embedding[1] < 0 and embedding[2] >= 0 then 2 when embedding[1] < 0 then 3 else 4 end::bigint quadrant, count(*) n from embeddings group by all",
    "fallback_original": f"{_BM25}, f as (select query_id, doc_id, score, rank pos, count(*) over (partition by query_id) n from run where rank <= 3), c as (select *, unnest(range(0, greatest(ceil(8 / n) - 1, 0)::bigint + 1)) copy from f) select query_id, doc_id, score, copy * n + pos rank, copy > 0 as fallback from c where copy * n + pos <= 8 or copy = 0",
    "mmr_relevance": "with k as (select q.vec_id query_id, v.vec_id doc_id, q.embedding::double[] a, v.embedding::double[] b, row_number() over (partition by q.vec_id order by round(list_dot_product(v.embedding::double[], q.embedding::double[]), 6) desc, v.vec_id) r from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id qualify r <= 5) select query_id, doc_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) score from k",
}

_NAMES = """hybrid_five search_dense search_fused search_dispatch entity_search smart_filters text_quality fuzzy_words ranked_runs chunk_strategy chunk_records structure_levels
split_sentences sparse_records index_rows upload_status raw_store match_all_sample expand_methods expand_suffixes annotate_intents intent_decisions weight_rewrite term_category vocab_save
synonym_expansion dictionary_terms entity_report advanced_features structure_features feature_fusion slot_context review_decisions dataset_report score_moments answer_metrics answer_means
sample_validity vector_quadrants fallback_original mmr_relevance""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}

"""More of the catalogue's queries in DuckDB's SQL: sentences, vocabularies, keywords, fields, entities, reports."""

from __future__ import annotations

from .catalog_sql import _BIO, _BM25, _DENSE10, _IDF, _KNN, _LUCENE, _MM, _TF, _TOKEN, _W, _run, _spans, _tok

_S = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？?!])\s*', '\1' || chr(1), 'g'), ';', ';' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and x <> ';')"
_WORDS = _W.format("text")
_SHAPES = r"list_distinct(list_concat(regexp_extract_all(text, '[A-Z][a-zA-Z一-鿿]+'), regexp_extract_all(text, '[A-Za-z一-鿿]+\d+'), regexp_extract_all(text, '[A-Za-z一-鿿]+之[A-Za-z一-鿿]+'), regexp_extract_all(text, '[A-Za-z一-鿿]{4,}')))"
_TERMS = f"terms as (select category, term, count(*) frequency from (select coalesce(lang, 'none') category, unnest({_SHAPES}) term from documents where text is not null) where length(term) >= 2 group by all)"
_LUCENE_IDF = f"{_TF}, l as (select term, ln(1 + (n - count(*) + 0.5::double) / (count(*) + 0.5::double)) idf from tf, n group by term, n)"
_KEYWORDS = ["the", "ing", "what"]


def _position(w: str) -> str:
    at = f"instr(text, '{w}')"
    before = f"substr(text, greatest({at} - 8, 1), {at} - greatest({at} - 8, 1))"
    return f"case when {at} = 0 then 0 when contains({before}, 'not ') then 0.9 when {at} - 1 < length(text) * 0.2::double then 0.8 when {at} - 1 > length(text) * 0.8::double then 0.9 else 1.2 end"


def _context(w: str) -> str:
    at = f"instr(text, '{w}')"
    before, after = f"substr(text, greatest({at} - 4, 1), {at} - greatest({at} - 4, 1))", f"substr(text, {at} + {len(w)}, 4)"
    return f"case when {at} = 0 then 0 else (case when contains({before}, 'of') then 1.3 else 1 end) * (case when contains({after}, 'and') then 1.2 else 1 end) end"


def _gap(a: str, b: str) -> str:
    score = (len(a) + len(b)) / (len(a) + len(b) + 3)
    return f"case when instr(text, '{a}') > 0 and contains(substr(text, instr(text, '{a}') + {len(a)}), '{b}') then {score}::double else 0 end"


_Q = f"q as (select query_id, term, count(*) qtf from (select item_id query_id, {_tok('text')} term from benchmark) group by all)"
_FIELDS = f"""fd as (select doc_id, field, boost, case field when 'text' then t when 'heading' then t[1:8] else regexp_extract_all(lower(source), '{_TOKEN}') end t
 from (select doc_id, source, regexp_extract_all(lower(text), '{_TOKEN}') t from documents), (values ('heading', 1.5::double), ('source', 1.2::double), ('text', 1.0::double)) f(field, boost)),
fl as (select doc_id, field, boost, t, len(t) dl from fd where len(t) > 0), fs as (select field, count(*) n, avg(dl) avgdl from fl group by all),
ft as (select doc_id, field, boost, dl, term, count(*) tf from (select doc_id, field, boost, dl, unnest(t) term from fl) group by all),
fdf as (select field, term, count(*) df from ft group by all),
fsc as (select query_id, doc_id, field, sum(qtf * boost * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) score from ft join fdf using (field, term) join fs using (field) join q using (term) group by all),
fb as (select query_id, doc_id, round(max(score) + 0.3::double * (sum(score) - max(score)), 6) score from fsc group by all),
multi as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from fb qualify rank <= 10)"""
_VARIANTS = r"list_concat([text], case when regexp_matches(text, '\bthe\b') then [regexp_replace(text, '\bthe\b', 'that', 'g'), regexp_replace(text, '\bthe\b', 'this', 'g')] else [] end, case when regexp_matches(text, '\bof\b') then [regexp_replace(text, '\bof\b', 'from', 'g')] else [] end, case when regexp_matches(text, '\bla\b') then [regexp_replace(text, '\bla\b', 'una', 'g')] else [] end)"
_VQ = f"v as (select item_id, {_VARIANTS} l from benchmark), vt as (select item_id * 16 + generate_subscripts(l, 1) - 1 query_id, unnest(l) as text from v), q as (select query_id, term, count(*) qtf from (select query_id, {_tok('text')} term from vt) group by all)"
_MASKED = ["of the", "the", "in", "ing", "in the"]
_FOUND = "ph(name) as (values {}), fe as (select doc_id, name, lower(text) low, (length(lower(text)) - length(replace(lower(text), name, ''))) // length(name) times, instr(lower(text), name) - 1 as first, length(text) n, text from documents, ph where contains(lower(text), name))"
_CUT = "case when length(token) > 11 then 'O' else fl end"

SQL = {
    "sentence_split": f"select doc_id, len({_S}) sentences from documents",
    "sentence_count": f"select doc_id, len({_S}) sentences, coalesce(list_sum(list_transform({_S}, lambda x: length(x))), case when text is null then null else 0 end)::bigint chars from documents",
    "coherence_score": f"with x as (select doc_id, text, {_S} s from documents) select doc_id, round(case when len(s) >= 2 then 0.3 else 0 end + case when coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) / greatest(len(s), 1) between 10 and 200 then 0.3 else 0 end + case when len(string_split(text, chr(10) || chr(10))) - 1 <= 3 then 0.2 else 0 end + case when length(regexp_replace(text, '[^。！？，；：]', '', 'g')) / greatest(length(text), 1) between 0.05 and 0.3 then 0.2 else 0 end, 6)::double score from x",
    "query_complexity": f"with x as (select conv_id, turn, text, {_WORDS} w from conversations where role = 'user'), y as (select conv_id, turn, case when len(w) > 0 then round((least(length(text) / 50.0::double, 1) + least(len(w) / 10.0::double, 1)) / 2, 6) else 0 end simple, case when len(w) > 0 then round((least(len(w) / 20.0::double, 1) + len(list_distinct(w)) / len(w) + len(list_filter(w, lambda i: length(i) > 4)) / len(w) + least(length(regexp_replace(text, '[^，。！？；：\"\"''''（）【】]', '', 'g')) / 10.0::double, 1)) / 4, 6) else 0 end advanced from x) select *, case when advanced < 0.3 then 'simple' when advanced < 0.7 then 'medium' else 'complex' end as level from y",
    "token_shapes": rf"select translate(regexp_replace(regexp_replace(regexp_replace(token, '\p{{Lu}}', chr(1), 'g'), '[\p{{Ll}}一-鿿]', chr(2), 'g'), '\p{{Nd}}', chr(3), 'g'), chr(1) || chr(2) || chr(3), 'Xxd') shape, count(*) n from (select unnest({_WORDS}) token from benchmark) group by all",
    "term_candidates": f"with {_TERMS} select * from terms where frequency >= 5",
    "vocab_merge": f"with {_TERMS} select * from terms where frequency >= 5",
    "vocab_priority": f"with {_TERMS} select term, arg_min(category, (coalesce(nullif(list_position(['es', 'de', 'fr', 'en'], category), 0), 999), category)) category, sum(frequency)::bigint frequency from terms group by term having sum(frequency) >= 5",
    "vocab_build": f"with {_TF}, a as (select term, sum(tf)::bigint freq, count(*) df from tf group by all), k as (select * from a where freq >= 10 order by freq desc, term limit 500) select * from k union all select t, coalesce(freq, 0), coalesce(df, 0) from (values ('the'), ('zzzz')) f(t) left join a on a.term = t where t not in (select term from k)",
    "idf_summary": f"with {_LUCENE_IDF} select count(*) size, round(avg(idf), 6) mean, round(max(idf), 6) largest, round(min(idf), 6) smallest from l",
    "idf_histogram": f"with {_LUCENE_IDF} select floor(round(idf, 6) / 0.5::double)::bigint bin, count(*) terms from l group by all",
    "category_boost": f"with {_IDF} select term, round(round(idf, 6) * case when term in ('the', 'of') then 0.5::double when term = 'und' then 2 else 1 end, 6) weight from idf",
    "synonym_check": f"with g as (select item_id line, {_W.format('lower(text)')}[1:4] terms from benchmark), e as (select line, unnest(terms) term from g), c as (select line, term, count(*) c from e group by all), f as (select term, min(line) first, count(*) n from c group by all having count(*) > 1) select line, null::varchar term, 'fewer than two terms' problem from g where len(terms) < 2 union all select line, term, 'repeated in its group' from c where c > 1 union all select line, term, 'repeated across groups' from c join f using (term) where line > first",
    "page_content_types": "with p as (select lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) h, page_id % 6 + 1 as level, upper(html) u from pages) select case when regexp_matches(h, '军队规则|army rule|战斗专注|殊途同归') then 'army_rule' when regexp_matches(h, '分队规则|detachment|军阵|host') then 'detachment_rule' when regexp_matches(h, '单位数据|unit|人物|character|步兵|infantry|载具|vehicle') then 'unit' when regexp_matches(h, '核心规则|core rule|游戏规则|game rule') then 'corerule' when level >= 3 and regexp_matches(u, 'M |T |SV |W |LD |OC ') and h <> '' then 'unit' else 'corerule' end kind, count(*) n from p group by all",
    "keyword_scores": "select conv_id, turn, round(" + " + ".join(map(_position, _KEYWORDS)) + ", 6)::double as position, round(" + " + ".join(map(_context, _KEYWORDS)) + f", 6)::double as context, round(greatest({_gap('the', 'of')}, {_gap('a', 'the and')}), 6) gapped from conversations where role = 'user'",
    "phrase_mask": "select doc_id, len(regexp_extract_all(text, '" + "|".join(sorted(_MASKED, key=len, reverse=True)) + "')) masked, true as same from documents where text is not null",
    "multi_field": f"with {_Q}, {_FIELDS} select query_id, doc_id, score, rank from multi",
    "mean_fusion": f"{_BM25}, {_FIELDS}, {_DENSE10}, x as (" + " union all ".join(f"select query_id, doc_id, round({_MM}, 6) / 3.0::double part from {t} window w as (partition by query_id)" for t in ("multi", "run", "dense")) + "), y as (select query_id, doc_id, round(sum(part), 6) score from x group by all) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from y qualify rank <= 10",
    "content_boosts": f"select conv_id, turn, (case when len({_WORDS}) > 20 then 1.4 else 1.2 end)::double boost from conversations where role = 'user'",
    "variants_fusion": f"with {_IDF}, {_VQ}, {_run('run', 20)}, y as (select query_id // 16 query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score from run group by all) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from y qualify rank <= 10",
    "char_tfidf": "with c as (select item_id doc_id, lower(text) t from benchmark), g as (select doc_id, substr(t, i, k) gram, count(*) tf from (select doc_id, t, k, unnest(range(1, length(t) - k + 2)) i from c, (values (1), (2), (3)) n(k)) group by all), n as (select count(*) n from benchmark), s as (select gram, sum(tf) freq, count(*) df from g group by all), k as (select gram, ln((1 + n) / (1 + df)) + 1 idf from s, n where df <= 0.8::double * n order by freq desc, gram limit 2000), w as (select doc_id, gram, (1 + ln(tf)) * idf w from g join k using (gram)) select doc_id, gram, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) weight from w",
    "entity_find": "with " + _FOUND.format(", ".join(f"('{x}')" for x in _MASKED)) + " select doc_id, name, times, first, round(least(2 * length(name) / n, 1), 6)::double confidence from fe",
    "entity_relations": "with " + _FOUND.format("(' the '), (' of '), (' and ')") + ", r as (select a.doc_id, a.name src, b.name dst, substr(a.text, least(a.first, b.first) + 1, greatest(a.first + length(a.name), b.first + length(b.name)) - least(a.first, b.first)) c from fe a join fe b using (doc_id) where a.name = ' the ' and b.name <> ' the ') select doc_id, src, dst, case when regexp_matches(c, '[0-9]') then 'NUMBERED' else 'NEAR' end relation from r where regexp_matches(c, '[0-9]|e')",
    "score_summary": f"{_BM25}, s as (select query_id, count(*) n, min(score) least, max(score) most, round(avg(score), 6) mean from run group by all) select *, case when least >= -1 and most <= 1 then 'dense' when least < -100 or most > 100 then 'hybrid' when least >= 0 and most > 1 then 'sparse' else 'generic' end kind from s",
    "cosine_all_pairs_hist": "select floor(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) * 20)::bigint bin, count(*) n from embeddings a, embeddings b where a.vec_id < b.vec_id group by all",
    "diversity_order": f"{_KNN}, u as (select query_id, doc_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) l from knn join embeddings on vec_id = doc_id), c as (select query_id, doc_id, generate_subscripts(v, 1) i, unnest(v) / l x from u), m as (select query_id, i, avg(x) m from c group by all) select query_id, doc_id, round(1 - sum(x * m), 6) diversity from c join m using (query_id, i) group by all",
    "fallback_stats": f"{_BM25}, f as (select query_id, count(*) n from run where rank <= 3 group by all) select count(*) queries, sum((n < 8)::int)::bigint fallbacks, sum(greatest(8 - n, 0))::bigint added from f",
    "overlap_counts": f"{_BM25}, {_LUCENE}, {_DENSE10}, x as (select query_id, doc_id, max(a) a, max(b) b, max(c) c from (select query_id, doc_id, 1 a, 0 b, 0 c from run union all select query_id, doc_id, 0, 1, 0 from luc union all select query_id, doc_id, 0, 0, 1 from dense) group by all) select query_id, sum(a)::bigint okapi_count, sum(b)::bigint lucene_count, sum(c)::bigint dense_count, sum(a * b * c)::bigint overlap, count(*) union_size from x group by all having sum(a) > 0 and sum(b) > 0 and sum(c) > 0",
    "low_score_queries": f"{_BM25}, t as (select query_id, max(score) score from run group by all) select * from t where score <= (select quantile_cont(score, 0.2) from t)",
    "frame_accuracy": f"with {_BIO}, w as (select sent_id, bool_or({_CUT} <> fl) wrong from fixed group by all), f as (select item_id % 3 = item_id % 6 % 3 and not coalesce(wrong, false) ok from benchmark left join w on sent_id = item_id) select count(*) frames, round(avg(ok::int), 6) accuracy from f",
    "sample_report": f"with a as (select length(coalesce(text, '')) n, coalesce(len(list_filter({_WORDS}, lambda x: length(x) > 9)), 0) c from conversations where role = 'assistant') select count(*) samples, round(avg(c), 6) mean_contexts, coalesce(sum((n < 60)::int), 0)::bigint short, coalesce(sum((n > 200)::int), 0)::bigint long, coalesce(sum((n < 60 or c = 0)::int), 0)::bigint problems from a",
    "token_positions": f"with {_BIO}, r as (select sent_id, pos, pos / count(*) over (partition by sent_id) r from bio) select sent_id, pos, pos = 0 is_first, floor(r * 4)::bigint + 1 \"quarter\", floor(r * 2)::bigint + 1 half from r",
    "slots_last": f"with {_BIO}, {_spans('fixed', 'fl', 'sp')} select sent_id, name, arg_max(value, \"start\") as value from sp group by all",
}

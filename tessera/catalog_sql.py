"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations


_TOKEN = r"[\p{L}\p{N}]+"


def _tok(t: str) -> str:
    return f"unnest(regexp_extract_all(lower({t}), '{_TOKEN}'))"


_TF = f"tok as (select doc_id, {_tok('text')} term from documents), tf as (select doc_id, term, count(*) tf from tok group by all), dl as (select doc_id, sum(tf) dl from tf group by all), n as (select count(*) n, avg(dl) avgdl from dl)"
_IDF = f"{_TF}, df as (select term, count(*) df from tf group by all), raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) r from df, n), idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end idf from raw)"
_Q = f"q as (select query_id, term, count(*) qtf from (select item_id query_id, {_tok('text')} term from benchmark) group by all)"


def _run(name: str = "run", k: int = 10, idf: str = "idf.idf", k1: float = 1.5) -> str:
    score = f"round(sum(qtf * {idf} * tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6)"
    return f"{name}_s as (select query_id, doc_id, {score} score from q join tf using (term) join idf using (term) join dl using (doc_id), n group by all), {name} as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from {name}_s qualify rank <= {k})"


_BM25 = f"with {_IDF}, {_Q}, {_run()}"
_LUCENE = _run("luc", 10, "ln(1 + (n - idf.df + 0.5) / (idf.df + 0.5))", 1.2)
_DOT = "round(list_dot_product(v.embedding::double[], qv.embedding::double[]), 6)"


def _knn(name: str, who: str, where: str = "true", k: int = 10) -> str:
    return f"{name} as (select qv.vec_id query_id, v.vec_id doc_id, {_DOT} score, row_number() over (partition by qv.vec_id order by {_DOT} desc, v.vec_id) rank from embeddings v, embeddings qv where {who} and v.vec_id <> qv.vec_id and {where} qualify rank <= {k})"


_ITEMS = "qv.vec_id in (select item_id from benchmark)"
_DENSE20 = _knn("dense", _ITEMS, "true", 20)
_DENSE10 = _knn("dense", _ITEMS, "true", 10)
_KNN = f"with {_knn('knn', 'qv.vec_id % 50 = 0')}"
_RUN20 = f"with {_IDF}, {_Q}, {_run('run', 20)}, {_DENSE20}"
_W = "filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')".replace("filter", "list_filter")
_GOLD = "gold as (select distinct b.item_id query_id, d.doc_id from documents d, benchmark b where contains(d.text, b.text))"
_METRIC = "m as (select g.query_id, count(*) relevant, count(r.rank) hits, min(r.rank) first from gold g left join (select query_id, doc_id, rank from {0} where rank <= 10) r on g.query_id = r.query_id and g.doc_id = r.doc_id group by all)"
_MM = "case when max(score) over w = min(score) over w then 0.5 else (score - min(score) over w) / (max(score) over w - min(score) over w) end"


def _grams(n: int, name: str = "g") -> str:
    t = "select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') t from documents"
    return f"{name}_p as (select doc_id, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) gram from ({t}) where len(t) >= {n}), {name}_d as (select doc_id, gram, count(*) c from {name}_p group by all), {name} as (select gram, sum(c)::bigint freq, count(*) df from {name}_d group by all)"


_PMI = f"{_grams(1, 'u')}, {_grams(2, 'g')}, pmi as (select g.gram phrase, g.freq, g.df, round(ln((g.freq / (select sum(freq) from g)) / ((a.freq / (select sum(freq) from u)) * (b.freq / (select sum(freq) from u))) + 1e-10), 6) pmi from g join u a on a.gram = split_part(g.gram, ' ', 1) join u b on b.gram = split_part(g.gram, ' ', 2) where g.freq >= 5)"
_BIO = f"bt as (select item_id sent_id, unnest({_W.format('text')}) token, generate_subscripts({_W.format('text')}, 1) - 1 pos from benchmark), bio as (select *, case when regexp_matches(token, '^[A-Z]') then 'B-NAME' when length(token) <= 3 then 'I-NAME' else 'O' end label from bt), fixed as (select *, case when label = 'I-NAME' and lag(label, 1, 'O') over (partition by sent_id order by pos) = 'O' then 'B-NAME' else label end fl from bio)"


def _spans(src: str, label: str, name: str) -> str:
    return f"{name}_i as (select *, sum(case when {label} like 'B-%' then 1 else 0 end) over (partition by sent_id order by pos) island from {src}), {name} as (select sent_id, 'NAME' as name, min(pos) \"start\", max(pos) \"end\", string_agg(token, ' ' order by pos) as value from {name}_i where {label} <> 'O' group by sent_id, island)"


_UNC = "p as (select event_id, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] p from (select event_id, abs(value) + 1.0::double a, length(props) + 1.0::double b, length(event_type) + 1.0::double c from events)), u as (select event_id, -(p[1] * ln(p[1]) + p[2] * ln(p[2]) + p[3] * ln(p[3])) / ln(3) e, list_reverse_sort(p) s from p), unc as (select event_id, round(e, 6) entropy, round(s[1], 6) confidence, round(s[1] - s[2], 6) margin, round(0.4 * e + 0.4 * (1 - s[1]) + 0.2 * (1 - (s[1] - s[2])), 6) uncertainty from u)"
_PATTERNS = "pat(name, type, alias) as (values ('the','article','the'), ('of','link','of'), ('to','link','to'), ('and','link','and'), ('para','link','para'), ('und','link','und'), ('la','article','la'), ('le','article','le'))"
_ENT = f"{_TF}, {_PATTERNS}, ent as (select doc_id, name, type, sum(tf)::bigint times from tf join pat on term = alias group by all)"
_INTENT = "case when {0} then 'compare' when {1} then 'list' when {2} then 'rule' when {3} then 'query' else 'unknown' end".format(
    *[" or ".join(f"contains(lower(text), '{w}')" for w in ws) for ws in (["compare", "versus", " vs ", "difference", "比较", "区别"], ["list", "which", "all of", "哪些", "列出"], ["rule", "how many", "can i", "规则", "是否"], ["what", "who", "where", "什么"])]
)

SQL = {
    "bm25_topk": f"{_BM25} select query_id, doc_id, score, rank from run",
    "bm25_lucene_topk": f"with {_IDF}, {_Q}, {_LUCENE} select query_id, doc_id, score, rank from luc",
    "term_stats": f"with {_IDF} select term, df, round(idf, 6) idf from idf",
    "postings_stats": f"with {_TF} select count(*) postings, sum(tf)::bigint tokens, count(distinct term) terms, max(tf) max_tf from tf",
    "sparse_top10": f"with {_IDF}, w as (select doc_id, term, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 9) w from tf join idf using (term) join dl using (doc_id), n), x as (select doc_id, term, round(w / max(w) over (partition by doc_id), 6) weight from w where w > 0) select doc_id, term, weight, row_number() over (partition by doc_id order by weight desc, term) rank from x qualify rank <= 10",
    "sparse_dot_search": f"with {_IDF}, w as (select doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) w from tf join idf using (term) join dl using (doc_id), n), {_Q}, ql as (select query_id, sum(qtf) dl from q group by all), qn as (select count(*) n, avg(dl) avgdl from ql), qraw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) r from q, qn group by term, n), qidf as (select term, case when r < 0 then 0.25 * (select avg(r) from qraw) else r end i from qraw), qw as (select query_id, term, i * qtf * 2.5 / (qtf + 1.5 * (0.25 + 0.75 * dl / avgdl)) qw from q join qidf using (term) join ql using (query_id), qn), s as (select query_id, doc_id, round(sum(w * qw), 6) score from w join qw using (term) where w > 0 and qw > 0 group by all) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s qualify rank <= 10",
    "phrase_passages": f"with t as (select doc_id, regexp_extract_all(lower(text), '{_TOKEN}') t from documents), d as (select doc_id, ' ' || array_to_string(t, '  ') || ' ' s from t), q as (select item_id query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{_TOKEN}'), '  ') || ' ' p from benchmark) select query_id, doc_id, (length(s) - length(replace(s, p, substr(p, 1, length(p) - 1)))) times from d join q on contains(s, p)",
    "phrase_pairs": f"with t as (select doc_id, unnest(t) term, generate_subscripts(t, 1) pos from (select doc_id, regexp_extract_all(lower(text), '{_TOKEN}') t from documents)), b as (select item_id, unnest(t) term, generate_subscripts(t, 1) pos from (select item_id, regexp_extract_all(lower(text), '{_TOKEN}') t from benchmark)), p as (select distinct x.term a, y.term c from b x join b y on x.item_id = y.item_id and y.pos = x.pos + 1), n as (select *, lead(term, 1) over w n1, lead(term, 2) over w n2 from t window w as (partition by doc_id order by pos)), h as (select a || ' ' || c phrase, doc_id, count(*) times from n join p on term = a where n1 = c or n2 = c group by all) select phrase, count(*) documents, sum(times)::bigint times from h group by all",
    "knn_exact": f"{_KNN} select * from knn",
    "knn_filtered": f"with {_knn('knn', 'qv.vec_id % 50 = 0', 'v.label in (1, 3, 5)')} select * from knn",
    "hybrid_weighted": f"{_RUN20}, x as (select query_id, doc_id, round({_MM}, 6) * 0.5 part from run window w as (partition by query_id) union all select query_id, doc_id, round({_MM}, 6) * 0.5 from dense window w as (partition by query_id)), y as (select query_id, doc_id, round(sum(part), 7) score from x group by all) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from y qualify rank <= 10",
    "hybrid_rrf": f"{_RUN20}, x as (select query_id, doc_id, rank from run union all select query_id, doc_id, rank from dense), y as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) score from x group by all) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from y qualify rank <= 10",
    "relevance_filter": f"{_BM25} select * from (select query_id, doc_id, round({_MM}, 6) norm from run window w as (partition by query_id)) where norm >= 0.3",
    "dynamic_lambda": "select conv_id, turn, case when n <= 17 then 0.9 when n <= 30 then 0.7 else 0.5 end::double weight from (select conv_id, turn, length(trim(text, ' ')) n from conversations where role = 'user')",
    "fallback_topup": f"{_BM25}, f as (select query_id, doc_id, score, count(*) over (partition by query_id) n, row_number() over (partition by query_id order by score desc, doc_id) pos from run where rank <= 3), c as (select *, unnest(range(0, greatest(ceil(8 / n) - 1, 0)::bigint + 1)) copy from f) select query_id, doc_id, score, copy * n + pos rank, copy > 0 as fallback from c where copy * n + pos <= 8 or copy = 0",
    "exact_dedup": "select min(doc_id) as keep, count(*) copies from documents where text is not null group by text having count(*) > 1",
    "best_fields_tie": "with f as (select doc_id, case when list_contains(regexp_extract_all(lower(lang), '[\\p{L}\\p{N}]+'), 'en') then 2.0 else 0.0 end::double a, case when list_contains(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+'), 'src1') then 1.5 else 0.0 end::double b, case when list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') then 1.0 else 0.0 end::double c from documents) select * from (select doc_id, round(greatest(a, b, c) + 0.3 * (a + b + c - greatest(a, b, c)), 6) score from f) where score > 0",
    "overlap_rerank": f"{_BM25}, x as (select query_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '{_TOKEN}')) a, list_distinct(regexp_extract_all(lower(d.text), '{_TOKEN}')) c from run join benchmark b on item_id = query_id join documents d using (doc_id)), y as (select query_id, doc_id, round(len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))), 6) score from x) select *, row_number() over (partition by query_id order by score desc, doc_id) rank from y qualify rank <= 5",
    "ngram_counts": f"with {_grams(2)} select * from g where freq >= 5",
    "trigram_counts": f"with {_grams(3)} select * from g where freq >= 5",
    "pmi_phrases": f"with {_PMI} select * from pmi where pmi >= 3",
    "auto_thresholds": f"with {_grams(2)} select trunc(quantile_cont(df, 0.1))::bigint mid, trunc(quantile_cont(df, 0.33))::bigint low from g where freq >= 5",
    "phrase_weights": f"with {_PMI}, p as (select * from pmi where pmi >= 1), t as (select trunc(quantile_cont(df, 0.1)) mid, trunc(quantile_cont(df, 0.33)) low from p), n as (select count(*) n from documents) select phrase, df, round((ln((n + 1) / (df + 1)) + 1) * (1 + case when df = 1 then 0.2 when df <= mid then 0.1 when df <= low then 0.0 else -0.5 end + case when pmi < 3 then -0.5 else 0.0 end), 6) weight from p, t, n",
    "vocab_coverage": f"with {_TF}, v as (select term from tf group by term having sum(tf) >= 50), t as (select term, count(*) c from (select {_tok('text')} term from benchmark) group by all), k as (select c, (term in (select term from v))::int known from t) select sum(c)::bigint total_tokens, count(*) unique_tokens, sum(known)::bigint covered_unique, sum(known * c)::bigint covered_tokens, round(1 - sum(known * c) / sum(c), 6) oov_rate, round(sum(known) / count(*), 6) coverage from k",
    "token_len_hist": "select length(t) len, count(*) n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) t from documents) group by all",
    "vocab_jaccard_by_lang": f"with v as (select distinct lang, {_tok('text')} term from documents where lang is not null), s as (select lang, count(*) n from v group by all), b as (select a.lang, c.lang other, count(*) common from v a join v c using (term) where a.lang < c.lang group by all) select b.lang, other, round(common / (s.n + o.n - common), 6) jaccard from b join s on s.lang = b.lang join s o on o.lang = other",
    "token_filters": f"select token, count(*) n from (select unnest({_W.format('text')}) token from documents) where not regexp_matches(token, '^[[:punct:]　-〿＀-￯]+$') and not regexp_matches(token, '^[#*`~>|=_-]+$') and lower(token) not in ('i','you','he','she','it','we','they','me','him','her','us','them','我','你','他','她','它','我们','你们','他们') and not regexp_matches(token, '<[^>]+>|&[a-z]+;') and lower(token) not in ('div','span','p','br','li','ul','ol','td','tr','table','nbsp','amp','lt','gt') and token not in ('的','地','得','了','着','过','the','a','an') and not regexp_matches(token, '^[0-9.]+$') group by all having count(*) >= 20",
    "retrieval_metrics": f"{_BM25}, {_GOLD}, {_METRIC.format('run')} select round(avg((hits > 0)::int), 6) hit_rate, round(avg(hits / relevant), 6) recall, round(avg(hits / 10), 6) as precision, round(avg(coalesce(1 / first, 0)), 6) mrr from m",
    "novelty_diversity": f"{_BM25}, {_GOLD} select round(count(*) filter (where not exists (select 1 from gold g where g.query_id = run.query_id and g.doc_id = run.doc_id)) / count(*), 6) novelty, round(count(distinct doc_id) / count(*), 6) diversity from run",
    "overlap3": f"{_BM25}, {_LUCENE}, {_DENSE10}, x as (select query_id, doc_id, count(*) c from (select query_id, doc_id from run union all select query_id, doc_id from luc union all select query_id, doc_id from dense) group by all) select query_id, count(*) union_size, sum((c = 3)::int)::bigint common, round(sum((c = 3)::int) / count(*), 6) ratio from x group by all",
    "union_recall": f"{_BM25}, {_DENSE10}, {_GOLD}, un as (select query_id, doc_id, min(rank) rank from (select query_id, doc_id, rank from run union all select query_id, doc_id, rank from dense) group by all), {_METRIC.format('un')} select round(avg((hits > 0)::int), 6) hit_rate, round(avg(hits / relevant), 6) recall from m",
    "score_distribution": f"{_KNN} select least(floor(score * 50), 49)::bigint bin, count(*) n from knn where score between 0 and 1 group by all",
    "confusion_matrix": "select quality truth, toxic pred, count(*) n from labels group by all",
    "classification_report": "with l as (select unnest([0, 1]) label), x as (select label, count(*) filter (where quality = label) support, count(*) filter (where toxic = label) predicted, count(*) filter (where quality = label and toxic = label) tp from l, labels group by all), y as (select *, case when predicted > 0 then tp / predicted else 0 end pr, case when support > 0 then tp / support else 0 end re from x) select label, round(pr, 6) as precision, round(re, 6) recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) f1, support from y",
    "query_expand": "with v as (select item_id query_id, list_concat([text], case when regexp_matches(text, '\\bthe\\b') then [regexp_replace(text, '\\bthe\\b', 'that', 'g'), regexp_replace(text, '\\bthe\\b', 'this', 'g')] else [] end, case when regexp_matches(text, '\\bof\\b') then [regexp_replace(text, '\\bof\\b', 'from', 'g')] else [] end, case when regexp_matches(text, '\\bla\\b') then [regexp_replace(text, '\\bla\\b', 'una', 'g')] else [] end) l from benchmark) select query_id, generate_subscripts(l, 1) - 1 variant, unnest(l) as text from v",
    "intent_route": f"with r(intent, topk, rerank) as (values ('query', 40, 20), ('rule', 40, 20), ('list', 60, 30), ('compare', 30, 20), ('unknown', 0, 0)), q as (select conv_id, turn, {_INTENT} intent from conversations where role = 'user') select conv_id, turn, intent, topk, rerank from q left join r using (intent)",
    "entity_match": f"with {_ENT} select * from ent",
    "entity_pairs": f"with {_ENT} select x.name a, y.name b, count(*) docs from ent x join ent y using (doc_id) where x.name < y.name group by all",
    "html_headings": "select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) heading, len(string_split(html, '<p>')) parts from pages",
    "logical_blocks": "with l as (select doc_id, unnest(string_split(text, chr(10))) as value, generate_subscripts(string_split(text, chr(10)), 1) line from documents), b as (select *, sum(regexp_matches(value, '^[A-Z][a-z]')::int) over (partition by doc_id order by line) block from l), t as (select doc_id, block, string_agg(value, chr(10) order by line) t from b group by all) select doc_id, count(*) blocks, max(length(t)) longest from t where trim(t, ' ') <> '' group by all",
    "bio_repair": f"with {_BIO} select sent_id, pos, fl as label from fixed",
    "bio_spans": f"with {_BIO}, {_spans('fixed', 'fl', 'sp')} select * from sp",
    "bio_validate": f"with {_BIO}, k as (select sent_id, label <> 'I-NAME' or lag(label, 1, 'O') over (partition by sent_id order by pos) <> 'O' ok from bio) select sent_id, bool_and(ok) as valid from k group by all",
    "token_context": f"with {_BIO} select sent_id, pos, lag(token, 1, '<START>') over w prev1, lead(token, 1, '<END>') over w next1, round(pos / count(*) over (partition by sent_id), 6) ratio, pos = count(*) over (partition by sent_id) - 1 is_last from bio window w as (partition by sent_id order by pos)",
    "slot_f1": f"with {_BIO}, cut as (select *, case when length(token) > 8 then 'O' else fl end pl from fixed), {_spans('fixed', 'fl', 'gs')}, {_spans('cut', 'pl', 'ps')}, c as (select (select count(*) from gs join ps using (sent_id, name, \"start\", \"end\")) tp, (select count(*) from gs) gold, (select count(*) from ps) pred) select tp, gold, pred, round(2 * (tp / pred) * (tp / gold) / (tp / pred + tp / gold), 6) f1 from c",
    "uncertainty_scores": f"with {_UNC} select * from unc",
    "review_queue": f"with {_UNC} select event_id, uncertainty from unc order by uncertainty desc, event_id limit 25",
    "stratified_split": "with x as (select doc_id, quality, (row_number() over (partition by quality order by (doc_id * 7919 + 42) % 10007, doc_id) - 1) / count(*) over (partition by quality) a from labels) select doc_id, quality, case when a < 0.2::double then 'test' when a < 0.3::double then 'val' else 'train' end split from x",
    "prompt_assembly": f"{_BM25}, f as (select query_id, text, min(rank) rank from run join documents using (doc_id) group by all), p as (select *, row_number() over (partition by query_id order by rank) pos from f qualify pos <= 3) select query_id, string_agg('[' || pos || '] ' || text, chr(10) order by pos) prompt from p group by all",
    "query_log_stats": "select event_type, count(*) n, round(avg(value), 6) mean, min(value) least, max(value) most, sum((value > 5.0)::int)::bigint slow from events group by all",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events group by all",
    "log_last": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) n from events qualify n <= 3",
    "incremental_index": f"with {_TF} select term, sum(tf)::bigint freq, count(*) df from tf group by all",
    "filter_dsl": "select l_linestatus, count(*) n, round(sum(l_extendedprice), 2) price from lineitem where l_returnflag = 'R' and l_linestatus in ('F', 'O') and l_quantity >= 10 and l_quantity < 20 group by all",
    "cosine_pairs_hist": f"{_KNN} select floor(score * 20)::bigint bin, count(*) n from knn group by all",
    "score_norm_clamp": f"{_BM25} select query_id, doc_id, greatest(0.0, least(1.0, score))::double norm from run",
    "score_norm_minmax": f"{_BM25} select query_id, doc_id, round({_MM}, 6) norm from run window w as (partition by query_id)",
    "score_norm_log_minmax": f"{_BM25}, l as (select query_id, doc_id, sign(score) * ln(1 + abs(score)) score from run) select query_id, doc_id, round({_MM}, 6) norm from l window w as (partition by query_id)",
    "score_norm_zscore": f"{_BM25} select query_id, doc_id, round(case when stddev_pop(score) over w = 0 then 0.5 else 1 / (1 + exp(-(score - avg(score) over w) / stddev_pop(score) over w)) end, 6) norm from run window w as (partition by query_id)",
}

"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table
from . import alignment, ann, chat, decontaminate, html_text, langid, merkle, mixing, ngram_join, quality, quality_rules, token_rollup, url_filter
from . import sql as _more_sql
from .store import Scratch, crc_mod

RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
#: The arguments' schema of the call that ``tool_messages`` derives from a question.
SCHEMAS = {
    "lookup": {
        "type": "object",
        "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["question", "turn"],
        "additionalProperties": False,
    }
}
TOKENIZER = "byte_bpe_50k"
TOKENIZER_PATH = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank file.
TOKENIZER_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def html_text_(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tool_messages(messages: DataFrame) -> DataFrame:
    """Calls and results derived from plain conversations, whose tables hold none.

    A user's message at turn t calls the tool ``lookup`` under the identifier ``q<t>`` with its text and turn; an assistant's message at
    turn t is the result of the call ``q<t - 1>``. So an answer that follows no question is an orphan, a question without an
    answer stays open, and an empty question has invalid arguments.
    """
    name = F.concat(F.lit("q"), (F.col("turn") - F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("string"))
    arguments = F.struct(F.coalesce("text", F.lit("")).alias("question"), F.col("turn").alias("turn"))
    call = F.to_json(F.struct(F.array(F.struct(name.alias("id"), F.lit("lookup").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name.alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    rows = messages.where("turn is not null and role in ('user', 'assistant')")
    user = F.col("role") == "user"
    return rows.select("conv_id", "turn", F.when(user, "assistant").otherwise("tool").alias("role"), F.when(user, call).otherwise(result).alias("text"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, and the calls and results that are derived from them, linked, ordered, validated and serialised."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_chats(messages.unionByName(tool_messages(messages)), SCHEMAS)


def decontaminate_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from the labels of the documents that pages share paragraphs with: toxic or of low quality is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("coalesce(toxic = 1, false) or coalesce(quality = 0, false)").alias("blocked"))
    judged = url_filter.judge(pages.select("page_id", "url"), url_filter.labels_by_content(pages, docs, labels), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents, which corrections put right: a batch, the same once more by a retry, and corrections.

    The first batch lacks every tenth document, holds every tenth twice, and has counts that are one too high for every tenth; the corrections insert,
    delete and revise these. A rollup that ignores a kind of change, or counts a retry, gives other totals.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    count = token_rollup.counter(f"{TOKENIZER_PATH}/{TOKENIZER}.tiktoken", TOKENIZER_PATTERN)
    rollup = token_rollup.Rollup(spark, scratch(spark, "token-rollup"))
    tenth = F.coalesce(F.pmod("doc_id", F.lit(10)), F.lit(9))
    # counted once, as both batches are made of the counts
    columns = ["source", "lang", F.lit(TOKENIZER).alias("tokenizer"), tenth.alias("tenth"), count(F.col("text")).alias("tokens")]
    counted = Scratch(spark, "token-counts").cut(docs.select(*columns))
    twice = F.explode(F.when(F.col("tenth") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    first = counted.where("tenth <> 0").withColumn("copy", twice).withColumns({"kind": F.lit("insert"), "tokens": F.col("tokens") + F.when(F.col("tenth") == 2, 1).otherwise(0), "old_tokens": F.lit(0)})
    kind = F.when(F.col("tenth") == 0, "insert").when(F.col("tenth") == 1, "delete").otherwise("revise")
    corrections = counted.where("tenth < 3").withColumns({"kind": kind, "old_tokens": F.when(F.col("tenth") == 2, F.col("tokens") + 1).otherwise(0)})
    for _ in range(2):
        rollup.commit("documents", first)
    rollup.commit("corrections", corrections)
    return rollup.totals()


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules and, in each language, the rules whose cutoffs the labelled documents certify."""
    measured = quality_rules.measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text")
    measured = Scratch(spark, "rules").cut(measured)
    found = quality_rules.thresholds(measured, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(measured, found)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.digest(alignment.align(docs, f"{TOKENIZER_PATH}/byte_bpe_50k.json", f"{TOKENIZER_PATH}/piece_bpe_32k.model"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's leaf, roots and proof, and the root that a leaf gives whose n_chars is one too many where 7 divides crc32(doc_id)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    more = leaf(F.col("n_chars").cast("decimal(20, 0)") + 1)
    tampered = F.when((crc_mod(F.col("doc_id"), 7) == 0) & F.col("n_chars").isNotNull(), more)
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(rows, "lang", "doc_id", ("tampered",))
    found = found.withColumns({"proof_sha256": merkle.proof(F.col("path")), "folded_root": merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {
        "op1_html_text": html_text_,
        "op2_mix_sources": mix_sources,
        "op3_chat_format": chat_format,
        "op4_decontaminate": decontaminate_,
        "op5_hnsw_nearest": nearest,
        "op6_quality": quality_score,
        "op7_url_filter": url_verdicts,
        "op8_language": language,
        "op9_ngram_jaccard": ngram_jaccard,
        "op10_token_rollup": token_counts,
        "op11_quality_rules": rule_verdicts,
        "op12_token_alignment": token_alignment,
        "op13_merkle_manifest": merkle_manifest,
    }


#: Exact links by shared shingles, and components by closure: for small tables only, as copies of a document meet in pairs.
_NGRAM_JACCARD = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from w),
e as (select doc_id, len(s) n, unnest(s) g from s),
p as (select a.doc_id x, b.doc_id y, a.n + b.n total, count(*) c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select x, y from p where 100 * c >= 85 * (total - c)),
r(x, y) as (select doc_id, doc_id from s union select r.x, l.y from r join l on r.y = l.x)
select s.doc_id, len(s.s) n_shingles, min(r.y) component_id from s join r on r.x = s.doc_id group by s.doc_id, s.s"""

SQL = {"op9_ngram_jaccard": _NGRAM_JACCARD, **_more_sql.SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""URL filtering: listed host and path rules first, mined association rules for the rest.

A URL is turned into typed tokens, at most eight: scheme, suffix, registered domain, host, number of labels, first and second folder of
the path, kind of ending. Over the labelled URLs, FP-growth mines the token combinations that go with a blocking label; those
with a minimum count, the same for any number of URLs, and a confidence of ``min_lift`` times the share of blocked ones among
all labelled URLs are the rules. An inverted index leads from a token to the rules of which it is the rarest; a rule fits a URL
that has all its tokens, and a URL that any rule fits is blocked.

Labels belong to documents, not to pages. ``labels_by_content`` links them where that is sound: by the paragraphs that a page
shares with labelled documents. Paragraphs are hashed within their row and counted before the join, so texts are never shuffled.

Eight tokens bound the frequent combinations by 2^8 times the labelled URLs over the minimum count. URLs with the same tokens are
judged once. Everything is DataFrame operations and Spark's own FP-growth.

Rows: a null URL or one without ``://`` has empty host and path, no tokens, fits no rule and is allowed; repeated
pages are judged alike, each with its row; labels that are null or of unknown pages do not count; empty tables give
no rules or no rows; of rules that tie, any blocks alike. Other columns stay, whatever their names; those named like the output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, free_name, replace_columns, sized

#: A rule blocks if the label is so many times as frequent with its tokens as without regard to them.
MIN_LIFT = 2.0
#: A rule rests on so many labelled URLs at least, however few there are in all.
MIN_COUNT = 20
_LABEL = "block!"
#: Paragraphs of fewer characters link no page to a document.
MIN_PARAGRAPH = 40


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(h: Column, p: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule (host and path together; then the longer host) as a struct, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.host)):
        fits = ((h == r.host) | h.endswith(F.lit("." + r.host))) & p.startswith(F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The typed tokens of a URL, none for an empty host."""
    h, p = host(url), path(url)
    labels, folders = F.split(h, r"\."), F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(labels)
    domain = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    folder = lambda i: F.when(F.size(folders) > i, F.regexp_replace(F.get(folders, F.lit(i)), r"[0-9]+", "0"))
    ending = F.when(url.contains("?"), "query").when(url.contains("#"), "fragment").when(p.endswith("/"), "folder").when(p.rlike(r"\.[a-z]+$"), "file").otherwise("plain")
    typed = [
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), F.concat(F.lit("suffix="), F.element_at(labels, -1)),
        F.concat(F.lit("domain="), domain), F.concat(F.lit("host="), h), F.concat(F.lit("labels="), n.cast("string")),
        F.concat(F.lit("first="), folder(0)), F.concat(F.lit("second="), folder(1)), F.concat(F.lit("end="), ending),
    ]
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*typed))))


def mine(labelled: DataFrame, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule_id, antecedent, confidence) from (url, blocked boolean); ``min_count`` URLs at least have a rule's antecedent and the label."""
    items = labelled.where("blocked is not null").select(tokens(F.col("url")).alias("items"), "blocked").where(F.size("items") > 0)
    rows, blocked = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    items = items.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(_LABEL)))).otherwise(F.col("items")).alias("items"))
    # FP-growth rounds support * rows up to a count; half a row less keeps that count from being one too many
    support = min(1.0, (min_count - 0.5) / max(1, rows))
    least = min(1.0, min_lift * blocked / max(1, rows))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=least).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_LABEL)))
    return rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence")


def _paragraphs(html: Column) -> Column:
    """Hashes of a page's runs of text between the tags of blocks, without inline tags, white space as one space."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\r\n\t ]+", " "), r"(?i)</?(?:p|h[1-6]|li|ul|ol|div|article|section|main|body|td|tr|table|br|blockquote)\b[^>]*>", "\n")
    plain = F.regexp_replace(plain, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return _line_hashes(plain)


def _line_hashes(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D ]+", " ")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= MIN_PARAGRAPH), lambda x: F.xxhash64(x)))


def labels_by_content(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, blocked) of the pages that share paragraphs with labelled documents.

    labels: (doc_id, blocked). A page is blocked if at least half of the labelled documents, counted for each paragraph that they
    share with it, are. Pages without such a paragraph have no row.
    """
    label = labels.where("doc_id is not null and blocked is not null").groupBy("doc_id").agg(F.max("blocked").alias("blocked"))
    held = documents.select("doc_id", _line_hashes(F.col("text")).alias("lines")).where(F.size("lines") > 0).join(label, "doc_id")
    lines = held.select(F.explode("lines").alias("line"), "blocked")
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"))
    found = pages.where("page_id is not null").select("page_id", F.explode(_paragraphs(F.col("html"))).alias("line")).join(lines, "line")
    return found.groupBy("page_id").agg((2 * F.sum("bad") >= F.sum("n")).alias("blocked"))


def match(urls: DataFrame, rules: DataFrame, rule_count: int) -> DataFrame:
    """(items, confidence) of the distinct token sets that a rule fits, by inverted index."""
    held = rules.select("rule_id", F.explode("antecedent").alias("token"))
    rarest = held.join(held.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = rules.join(rarest, "rule_id").select("token", "antecedent", "confidence")
    sets = urls.select(tokens(F.col("url")).alias("items")).where(F.size("items") > 0).distinct()
    hits = sets.select("items", F.explode("items").alias("token")).join(sized(index, rule_count), "token")
    full = hits.where(F.size(F.array_except("antecedent", "items")) == 0)
    return full.groupBy("items").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """The pages with host, path, rule, verdict, and the confidence of the mined rule if that decided, else null.

    labels: (page_id, blocked); a page is labelled block if any of its labels is.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    label = labels.where("page_id is not null and blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    mined = scratch.cut(mine(pages.select("page_id", "url").join(label, "page_id"), min_lift, min_count))
    count = mined.count()
    h, p = host(F.col("url")), path(F.col("url"))
    found = listed(h, p, rules)
    items, conf = free_name(pages, "_items"), free_name(pages, "_confidence")
    if count:
        bad = match(pages.select("url"), mined, count)
        bad = scratch.cut(bad.select(F.col("items").alias(items), F.col("confidence").alias(conf)))
        judged = pages.withColumn(items, tokens(F.col("url"))).join(sized(bad, bad.count()), items, "left")
    else:
        judged = pages.withColumns({items: F.lit(None), conf: F.lit(None).cast("double")})
    default = F.when(F.col(conf).isNotNull(), "block").otherwise("allow")
    new = {"host": h, "path": p, "rule": found["rule"], "verdict": F.coalesce(found["verdict"], default), "confidence": F.when(found.isNull(), F.col(conf))}
    return replace_columns(judged, new).drop(items, conf)

"""BIO label sequences (sent_id, pos, token, label): repair, validity, spans, context features, slot scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _seq() -> W:
    return W.partitionBy("sent_id").orderBy("pos")


def _before() -> tuple[F.Column, F.Column]:
    label, last = F.col("label"), F.lag("label", 1, "O").over(_seq())
    inside = label.startswith("I-")
    fits = (last.startswith("B-") | last.startswith("I-")) & (F.substr(last, F.lit(3)) == F.substr(label, F.lit(3)))
    return inside, fits


def repair(seq: DataFrame) -> DataFrame:
    """An I- label without its B- or I- before becomes B-; the kind stays, so the label before decides alone."""
    inside, fits = _before()
    return seq.withColumn("label", F.when(inside & ~fits, F.concat(F.lit("B-"), F.substr("label", F.lit(3)))).otherwise(F.col("label")))


def cleaned(seq: DataFrame, bad: float = 0.3) -> DataFrame:
    """Sentences of two tokens or more, without blank tokens, trimmed and numbered anew.

    ValueError if a label is none of O, B- and I- with a name, or if more than the share ``bad`` of the sentences is lost.
    """
    sent, token = W.partitionBy("sent_id"), F.trim("token")
    kept = seq.where(token != "").withColumns({"token": token, "_n": F.count(F.lit(1)).over(sent)}).where("_n >= 2")
    wrong = F.sum((~F.coalesce(F.col("label").rlike(r"^(O|[BI]-.+)$"), F.lit(False))).cast("long"))
    given, labels = seq.agg(F.countDistinct("sent_id"), wrong).first()
    if labels:
        raise ValueError(f"{labels} labels are malformed")
    stay = kept.select(F.countDistinct("sent_id")).first()[0]
    if given and (given - stay) / given > bad:
        raise ValueError(f"{given - stay} of {given} sentences are unusable")
    return kept.withColumn("pos", F.row_number().over(_seq()) - 1).drop("_n")


def validity(seq: DataFrame) -> DataFrame:
    """(sent_id, valid)."""
    inside, fits = _before()
    ok = F.col("label").rlike(r"^(O|[BI]-.+)$") & (~inside | fits)
    return seq.select("sent_id", ok.alias("ok")).groupBy("sent_id").agg(F.bool_and("ok").alias("valid"))


def spans(seq: DataFrame) -> DataFrame:
    """(sent_id, name, start, end, value): gaps and islands over the running count of B- labels."""
    marked = seq.withColumn("island", F.sum(F.when(F.col("label").startswith("B-"), 1).otherwise(0)).over(_seq())).where("label <> 'O'")
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    g = marked.groupBy("sent_id", "island").agg(F.min_by(F.substr("label", F.lit(3)), "pos").alias("name"), F.min("pos").alias("start"), F.max("pos").alias("end"), value.alias("value"))
    return g.select("sent_id", "name", "start", "end", "value")


def context(seq: DataFrame, width: int = 2) -> DataFrame:
    """Neighbouring tokens and the position in the sequence."""
    out = seq
    for i in range(1, width + 1):
        out = out.withColumn(f"prev{i}", F.lag("token", i, "<START>").over(_seq())).withColumn(f"next{i}", F.lead("token", i, "<END>").over(_seq()))
    n = F.count(F.lit(1)).over(W.partitionBy("sent_id"))
    return out.withColumn("ratio", F.round(F.col("pos") / n, 6)).withColumn("is_last", F.col("pos") == n - 1)


def slot_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 over whole spans."""
    key = ["sent_id", "name", "start", "end"]
    g, p = spans(gold).select(key), spans(pred).select(key)
    n = g.join(p, key, "left_semi").agg(F.count(F.lit(1)).alias("tp")).join(g.agg(F.count(F.lit(1)).alias("gold"))).join(p.agg(F.count(F.lit(1)).alias("pred")))
    pr, re = F.try_divide("tp", "pred"), F.try_divide("tp", "gold")
    return n.select("tp", "gold", "pred", F.round(F.try_divide(2 * pr * re, pr + re), 6).alias("f1"))


def slots_by_name(seq: DataFrame) -> DataFrame:
    """(sent_id, name, value): of several spans of one name the last counts."""
    return spans(seq).groupBy("sent_id", "name").agg(F.max_by("value", "start").alias("value"))


def position_features(seq: DataFrame) -> DataFrame:
    """Position in the sequence: ratio, first, last, quarter (1 to 4) and half (1 or 2)."""
    n = F.count(F.lit(1)).over(W.partitionBy("sent_id"))
    ratio = F.col("pos") / n
    return seq.withColumns({"ratio": F.round(ratio, 6), "is_first": F.col("pos") == 0, "is_last": F.col("pos") == n - 1, "quarter": (F.floor(ratio * 4) + 1).cast("int"), "half": (F.floor(ratio * 2) + 1).cast("int")})


def align(spans_: DataFrame, tokens_: DataFrame) -> DataFrame:
    """BIO labels of tokens (sent_id, pos, token, start, end) from character spans (sent_id, name, start, end), ends exclusive.

    A token belongs to the first span that it overlaps; the first token of a span begins it.
    """
    s = spans_.select("sent_id", "name", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = tokens_.join(s, "sent_id").where("start < e and s < end").groupBy("sent_id", "pos").agg(F.min(F.struct("s", "e", "name")).alias("x"))
    begin = F.row_number().over(W.partitionBy("sent_id", "x").orderBy("pos")) == 1
    named = hit.select("sent_id", "pos", F.concat(F.when(begin, "B-").otherwise("I-"), F.col("x.name")).alias("label"))
    return tokens_.join(named, ["sent_id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def slot_report(seq: DataFrame) -> DataFrame:
    """One row: sentences, tokens, labels that occur, and mean, least and greatest length of a sentence."""
    each = seq.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n"))
    labels = seq.agg(F.countDistinct("label").alias("labels"))
    out = each.agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.min("n"), F.lit(0)).alias("shortest"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))
    return out.join(labels)


def slot_names(labels: F.Column) -> F.Column:
    """The distinct names of an array of labels, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x.rlike("^[BI]-")), lambda x: F.substr(x, F.lit(3)))))


def training_rows(rows: DataFrame) -> DataFrame:
    """Of texts with their characters' labels (text, labels) those whose labels are valid, with the characters as tokens."""
    at = F.sequence(F.lit(0), F.size("labels") - 1)

    def ok(i: F.Column) -> F.Column:
        x, last = F.get("labels", i), F.coalesce(F.get("labels", i - 1), F.lit("O"))
        return x.rlike(r"^(O|[BI]-.+)$") & (~x.startswith("I-") | (last != "O") & (F.substr(last, F.lit(3)) == F.substr(x, F.lit(3))))

    kept = rows.where(F.size("labels") > 0).where(F.forall(at, ok))
    return kept.withColumn("tokens", F.filter(F.split("text", ""), lambda c: c != ""))

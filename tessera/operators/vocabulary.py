"""Vocabularies of (category, term, frequency, synonyms): building, merging, priorities, checks, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_shapes
from ..session import bounded

# The categories of a term, the most important first.
PRIORITY = ["units", "skills", "weapons", "detachments", "factions", "mechanics"]


def build(tf: DataFrame, least: int = 1, most: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    """(term, freq, df) of terms with at least ``least`` occurrences, the ``most`` frequent of them, and all forced terms (term)."""
    return frequent(tf.groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")), least, most, forced)


def frequent(all_terms: DataFrame, least: int = 1, most: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    """``build`` of counted terms (term, freq, df)."""
    kept = all_terms.where(F.col("freq") >= least)
    kept = kept if most is None else kept.orderBy(F.desc("freq"), "term").limit(most)
    if forced is None:
        return kept
    forced = forced.select("term").distinct()
    known = all_terms.join(bounded(forced), "term", "left_semi")
    extra = forced.join(known, "term", "left").na.fill(0, ["freq", "df"])
    return kept.unionByName(extra.join(kept.select("term"), "term", "left_anti"))


def category_boost(weights: DataFrame, categories: DataFrame, factor: float = 1.0) -> DataFrame:
    """Weights (…, term, weight) times the factor of their term's category (term, factor); others times ``factor``."""
    best = categories.groupBy("term").agg(F.max("factor").alias("factor"))
    return weights.join(best, "term", "left").withColumn("weight", F.round(F.col("weight") * F.coalesce("factor", F.lit(factor)), 6)).drop("factor")


def from_texts(rows: DataFrame) -> DataFrame:
    """(category, term, frequency): likely terms of (category, text), by the number of texts that hold them."""
    return rows.select("category", F.explode(term_shapes(F.col("text"))).alias("term")).where(F.length("term") >= 2).groupBy("category", "term").agg(F.count(F.lit(1)).alias("frequency"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vocabularies added up: frequencies by category and term; synonyms without repetition, in order."""
    both = old.unionByName(new, allowMissingColumns=True)
    out = [F.sum("frequency").alias("frequency")]
    if "synonyms" in both.columns:
        out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("synonyms")))).alias("synonyms"))
    return both.groupBy("category", "term").agg(*out)


def by_priority(vocab: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each term in its most important category only; unknown categories come last, by name."""
    place = F.array_position(F.array(*[F.lit(c) for c in order or PRIORITY]), F.col("category"))
    key = F.struct(F.when(place > 0, place).otherwise(999), F.col("category"))
    return vocab.groupBy("term").agg(F.min_by("category", key).alias("category"), F.sum("frequency").alias("frequency"))


def check_synonyms(groups: DataFrame) -> DataFrame:
    """(line, term, problem) of synonym groups (line, terms): small groups, repetitions within and across, bad characters."""
    small = groups.where(F.size("terms") < 2).select("line", F.lit(None).cast("string").alias("term"), F.lit("fewer than two terms").alias("problem"))
    each = groups.select("line", F.explode("terms").alias("term"))
    blank = each.where(F.trim("term") == "").select("line", "term", F.lit("empty term").alias("problem"))
    bad = each.where(F.col("term").rlike(r"[\t\n\r]")).select("line", "term", F.lit("forbidden character").alias("problem"))
    counted = each.groupBy("line", "term").agg(F.count(F.lit(1)).alias("c"))
    twice = counted.where("c > 1").select("line", "term", F.lit("repeated in its group").alias("problem"))
    first = counted.groupBy("term").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    across = counted.join(first, "term").where("line > first").select("line", "term", F.lit("repeated across groups").alias("problem"))
    return small.unionAll(blank).unionAll(bad).unionAll(twice).unionAll(across)


def flatten(vocab: DataFrame) -> DataFrame:
    """(category, term): terms and their synonyms, without blanks and repetitions."""
    return vocab.select("category", F.explode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term")).where(F.trim("term") != "").distinct()


def idf_summary(stats: DataFrame) -> DataFrame:
    """One row over (term, idf): size, mean, largest, smallest."""
    return stats.agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("idf"), 6).alias("mean"), F.round(F.max("idf"), 6).alias("largest"), F.round(F.min("idf"), 6).alias("smallest"))


def idf_histogram(stats: DataFrame, width: float = 0.5) -> DataFrame:
    """(bin, terms) of idf by bins of a width."""
    return stats.groupBy(F.floor(F.round(F.col("idf"), 6) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("terms"))


def dictionary_line(term: Column, freq: Column, tag: str = "n") -> Column:
    """``term freq tag``, a line of a segmenter's dictionary."""
    return F.concat_ws(" ", term, freq.cast("long").cast("string"), F.lit(tag))


def rewrite_weights(lines: DataFrame, factors: DataFrame) -> DataFrame:
    """Dictionary lines ``phrase weight [tag]`` (value) with the weight times the phrase's factor (term, factor), cut to an integer.

    A weight that is no integer counts 1, a missing tag is n; lines of one part are left out.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 2)
    number = F.coalesce(F.col("p")[1].try_cast("int"), F.lit(1))
    rows = rows.select(F.col("p")[0].alias("term"), number.alias("weight"), F.coalesce(F.get("p", F.lit(2)), F.lit("n")).alias("tag"))
    best = factors.groupBy("term").agg(F.max("factor").alias("factor"))
    out = rows.join(best, "term", "left").withColumn("weight", (F.col("weight") * F.coalesce("factor", F.lit(1.0))).cast("int"))
    return out.select(F.concat_ws(" ", "term", F.col("weight").cast("string"), "tag").alias("value"))


def category_of(terms: DataFrame, vocabulary: DataFrame, order: list[str] = PRIORITY) -> DataFrame:
    """(term, category): the first category in the order that holds the term; those of no category get null."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category")), F.lit(0))
    known = vocabulary.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1)).groupBy("term").agg(F.min(F.struct("place", "category")).alias("x"))
    return terms.select("term").distinct().join(known.select("term", "x.category"), "term", "left")


def save(vocabulary: DataFrame, old: DataFrame, overwrite: bool = False) -> DataFrame:
    """The new state of a saved vocabulary (category, term, frequency): new terms come in; known ones are replaced, or gain one in frequency."""
    key = ["category", "term"]
    both = old.select(*key, F.col("frequency").alias("was")).join(vocabulary.select(*key, F.col("frequency").alias("now")), key, "full")
    known = F.col("now") if overwrite else F.col("was") + 1
    return both.select(*key, F.when(F.col("now").isNull(), F.col("was")).when(F.col("was").isNull(), F.col("now")).otherwise(known).alias("frequency"))


def entity_view(vocabulary: DataFrame) -> DataFrame:
    """Terms as entities with defaults: (name, type, synonyms, frequency)."""
    have = set(vocabulary.columns)
    synonyms = F.coalesce("synonyms", F.array().cast("array<string>")) if "synonyms" in have else F.array().cast("array<string>")
    frequency = F.coalesce(F.col("frequency").cast("long"), F.lit(1)) if "frequency" in have else F.lit(1).cast("long")
    return vocabulary.select(F.col("term").alias("name"), F.coalesce("category", F.lit("general")).alias("type"), synonyms.alias("synonyms"), frequency.alias("frequency"))


def of_queries(queries: DataFrame) -> DataFrame:
    """(category, term, frequency): likely terms of questions (text), all of the category general."""
    return from_texts(queries.select(F.lit("general").alias("category"), "text"))


def expand_synonyms(tokens_: DataFrame, groups: DataFrame) -> DataFrame:
    """Tokens (key, term) and, for each, the other terms of the groups (line, term) that hold it: (key, term, given)."""
    mates = groups.select("line", "term").distinct()
    other = mates.withColumnRenamed("term", "mate")
    pairs = mates.join(other, "line").where("term <> mate").select("term", "mate").distinct()
    extra = tokens_.join(pairs, "term").select("key", F.col("mate").alias("term"), F.col("term").alias("given"))
    return tokens_.select("key", "term", F.col("term").alias("given")).unionByName(extra).distinct()


def kept_terms(tokens_: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens (key, term) that the dictionary (term) holds."""
    return tokens_.join(dictionary.select("term").distinct(), "term", "left_semi").select(*tokens_.columns)


def frequency_dictionary(stats: DataFrame) -> DataFrame:
    """(term, freq, df, weight) of ``lexical.corpus``: the document frequency's logarithm as weight, for a dictionary's file."""
    return stats.where("term is not null").select("term", "freq", "df", F.round(F.ln(1 + F.col("df")), 6).alias("weight"))


def merged_whitelist(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(term): mined phrases (phrase) and the vocabulary's terms and synonyms, each once."""
    own = terms.select(F.explode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term"))
    return phrases.select(F.col("phrase").alias("term")).union(own).where("trim(term) <> ''").distinct()


def grouped_entities(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, names): each document's distinct entities of each type, by name."""
    return entities.groupBy(key, "type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def first_wins(rules: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """Entities of the rules, and those of the model that the rules do not have by the key."""
    return rules.unionByName(model.join(rules.select(*key).distinct(), key, "left_anti").select(*rules.columns))

"""Sources and sinks of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, cut


def text_folder(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(source_file, text) of all files below a folder that match; unreadable ones are skipped."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True)
    return reader.text(path).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def labelled_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("query", "intent")) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """rows read with ``_file``, ``_start`` (of the split) and ``_row`` (an increasing id), numbered from 0 by file name and place.

    The numbers are the same however the read was split: the rows of each split are counted, and those of earlier splits and files come before.
    """
    counts = rows.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # as many rows as files' splits, not as sentences
    files = cut(counts.groupBy("_file").agg(F.sum("_n").alias("_all")))
    each = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    split = counts.withColumn("_before", F.coalesce(F.sum("_n").over(each), F.lit(0)))
    total = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    earlier = files.select("_file", F.coalesce(F.sum("_all").over(total), F.lit(0)).alias("_earlier"))
    shift = split.join(earlier, "_file").select("_file", "_start", (F.col("_before") + F.col("_earlier") - F.col("_first")).alias("_shift"))
    return rows.join(bounded(cut(shift)), ["_file", "_start"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_file", "_start", "_row", "_shift")


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, pos, token, label): sentences between blank lines, a token and its label on each line.

    ``sent_id`` counts the sentences in the order of file names and places, whatever the read's splits; equal sentences have ids of their own.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    raw = spark.read.option("lineSep", "\n\n").text(path).select("value", *place)
    sent = in_file_order(cut(raw.where(F.trim("value") != "")), "sent_id").select("sent_id", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    part = F.split("line", r"\s+")
    return sent.select("sent_id", "pos", part[0].alias("token"), F.coalesce(F.get(part, F.lit(1)), F.lit("O")).alias("label"))


def write_conll(seq: DataFrame, path: str) -> None:
    """One sentence after another, with a blank line between; written beside and never over the input."""
    line = F.concat_ws("\t", "token", "label")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    seq.groupBy("sent_id").agg(text.alias("value")).select("value").write.option("lineSep", "\n\n").mode("errorifexists").text(path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) from a JSON object of lists."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("query_id", "ids")).select("query_id", F.explode("ids").alias("doc_id"))


def query_list(spark: SparkSession, path_or_query: str) -> DataFrame:
    """(query_id, text) from a JSON file with a list or an object of queries, or of the argument itself as the one query."""
    if not path_or_query.strip().endswith(".json"):
        return spark.createDataFrame([(0, path_or_query)], "query_id long, text string")
    raw = spark.read.option("wholetext", True).text(path_or_query)
    found = F.coalesce(F.from_json("value", "array<string>"), F.map_values(F.from_json("value", "map<string,string>")))
    rows = raw.select(F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(found).alias("q"))
    return rows.select(F.posexplode("q").alias("i", "text")).where("text is not null").select(F.col("i").cast("long").alias("query_id"), "text")


def latest(spark: SparkSession, folder: str, glob: str) -> str | None:
    """The file of the folder that matches and comes last by name (names hold time stamps), or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(x.getPath()) for x in found or []), default=None)


def weighted_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight) from ``{term: {weight}}``, ``{vocabulary: {term: number}}`` or ``{term: number}``."""
    return _weights(spark.read.option("wholetext", True).text(path))


def dictionary_content(spark: SparkSession, content: bytes | str) -> DataFrame:
    """The same from a file's content instead of its name."""
    return _weights(spark.createDataFrame([(content.decode("utf-8") if isinstance(content, bytes) else content,)], "value string"))


def _weights(raw: DataFrame) -> DataFrame:
    heavy = F.map_filter(F.from_json("value", "map<string,struct<weight:double>>"), lambda k, v: v["weight"].isNotNull())
    nested = F.from_json(F.get_json_object("value", "$.vocabulary"), "map<string,double>")
    plain = F.map_filter(F.from_json("value", "map<string,double>"), lambda k, v: v.isNotNull())
    pick = F.when(F.size(heavy) > 0, F.transform_values(heavy, lambda k, v: v["weight"])).otherwise(F.coalesce(nested, plain))
    return raw.select(F.explode(pick).alias("term", "weight"))


def user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(phrase): the first word of each line that isn't blank, once."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("phrase")).where("phrase <> ''").distinct()


def write_dictionary(phrases: DataFrame, path: str) -> None:
    """Lines ``phrase weight n`` (cut to integers) in ``path/words`` and their figures as JSON lines in ``path/meta``."""
    line = F.concat_ws(" ", "phrase", F.col("weight").cast("long").cast("string"), F.lit("n"))
    phrases.select(line.alias("value")).write.mode("errorifexists").text(f"{path}/words")
    phrases.write.mode("errorifexists").json(f"{path}/meta")


def write_report(figures: DataFrame, path: str, title: str) -> None:
    """All rows, in their order, as a Markdown table in one text file."""
    spark = figures.sparkSession
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in figures.columns]
    head = [f"# {title}", "", "| " + " | ".join(figures.columns) + " |", "|" + "-|" * len(figures.columns)]
    top = spark.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    rows = figures.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    top.union(rows).coalesce(1).write.mode("overwrite").text(path)


def vocabulary(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(category, term, type, frequency, synonyms) from one JSON object of terms a file, named by category.

    A folder without such a file is replaced by the fallback's.
    """
    if fallback and latest(spark, path, "*.json") is None:
        path = fallback
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    entry = "map<string,struct<type:string,frequency:bigint,synonyms:array<string>,category:string>>"
    rows = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("category"), F.explode(F.from_json("value", entry)).alias("term", "e"))
    return rows.select("category", "term", F.col("e.type").alias("type"), F.coalesce("e.frequency", F.lit(0)).alias("frequency"), F.coalesce("e.synonyms", F.array().cast("array<string>")).alias("synonyms"))


def synonym_lines(vocab: DataFrame) -> DataFrame:
    """Comma-separated groups of two terms or more."""
    return vocab.where(F.size("synonyms") > 0).select(F.array_join(F.array_distinct(F.concat(F.array("term"), "synonyms")), ",").alias("value"))


def upsert_index(new: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Rows of the new table replace those of the same key; the rest of their buckets stays, and other buckets aren't read.

    The table is laid out by a hash of the key in a column that names the number of buckets. A batch's buckets are written to
    the shared folder first, so that the table is never read while it is overwritten, and a batch that is run again gives
    the same table. Columns that only one side has are null in the other's rows.
    """
    spark, bucket = new.sparkSession, f"_bucket{buckets}"
    out = new.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        old = spark.read.parquet(path)
        if bucket not in old.columns:
            raise ValueError(f"{path} isn't laid out in {buckets} buckets")
        touched = [r[0] for r in out.select(bucket).distinct().collect()]
        out = old.where(F.col(bucket).isin(touched)).join(new.select(key), key, "left_anti").unionByName(out, allowMissingColumns=True)
    cut(out).repartition(bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rewrite_conll(seq: DataFrame, path: str) -> None:
    """The sentences in place of those at path, which stay beside it as ``<path>_backup``; the new file is whole before it is moved."""
    spark = seq.sparkSession
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged, backup = made(path), made(path + "_staged"), made(path + "_backup")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(staged, True)
    write_conll(seq, path + "_staged")
    if fs.exists(target):
        fs.delete(backup, True)
        if not fs.rename(target, backup):
            raise OSError(f"can't move {path}")
    if not fs.rename(staged, target):
        fs.rename(backup, target)
        raise OSError(f"can't move {path}_staged to {path}")


def golden_set(spark: SparkSession, intents: str, slots: str) -> DataFrame:
    """(place, query, intent, tokens, labels): the n-th query of CSV files with the n-th sentence of label files, by file name and place.

    Unequal numbers of rows raise ValueError.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    q = in_file_order(cut(labelled_csv(spark, intents).select("query", "intent", *place)), "place")
    words = F.array_sort(F.collect_list(F.struct("pos", "token", "label")))
    s = cut(conll(spark, slots).groupBy("sent_id").agg(words.alias("w")).select(F.col("sent_id").alias("place"), F.col("w.token").alias("tokens"), F.col("w.label").alias("labels")))
    a, b = q.count(), s.count()
    if a != b:
        raise ValueError(f"{a} queries, but {b} sentences")
    return q.join(s, "place").select("place", "query", "intent", "tokens", "labels")


def write_splits(rows: DataFrame, path: str, split: str = "split", names: tuple[str, ...] = ("train", "val", "test")) -> None:
    """Each split in a folder of its name: label files for (sent_id, pos, token, label), else CSV with a header."""
    sequences = {"sent_id", "pos", "token", "label"} <= set(rows.columns)
    for name in names:
        part = rows.where(F.col(split) == name).drop(split)
        if sequences:
            write_conll(part, f"{path}/{name}")
        else:
            part.write.mode("errorifexists").option("escape", '"').csv(f"{path}/{name}", header=True)


def append_log(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """JSON lines beside those that are there; a file that has ``most`` rows is followed by another."""
    rows.write.mode("append").option("maxRecordsPerFile", most).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines below the path, each task a part; never over files that are there."""
    chunks.write.mode("errorifexists").json(path)


#: The fields of a chunk's preview.
PREVIEW_FIELDS = ("section_heading", "chunk_type", "content_type", "faction", "h1", "h2", "h3", "h4", "h5", "h6")


def write_chunk_preview(chunks: DataFrame, path: str, shown: int = 200) -> None:
    """Chunks as text: their fields by name and the first ``shown`` characters on one line, a blank line after each."""
    heads = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) if c in chunks.columns else F.lit(f"{c}: ") for c in PREVIEW_FIELDS]
    text = F.concat(F.lit("text: "), F.regexp_replace(F.substring("text", 1, shown), r"\n", " "), F.lit(" ..."))
    number = F.concat(F.lit("----- chunk "), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("doc_id", "section", "chunk") if c in chunks.columns]), F.lit(" -----"))
    chunks.select(F.concat_ws("\n", number, *heads, text, F.lit("")).alias("value")).write.mode("errorifexists").text(path)


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """(term, weight, freq, df) in both forms of a vocabulary: ``plain`` rows of term and weight, ``freq`` rows of term and all three, as JSON lines."""
    terms.select("term", "weight").write.mode("errorifexists").json(f"{path}/plain")
    terms.select("term", F.struct("weight", "freq", "df").alias("entry")).write.mode("errorifexists").json(f"{path}/freq")


def summary_report(metrics: dict, confusion: DataFrame | None = None) -> str:
    """A Markdown summary of frame_accuracy, intent_accuracy and the slots' precision, recall and f1 (missing ones are 0), and a table of counts (truth, pred, n)."""
    value = lambda n: f"{metrics.get(n, 0):.4f}"
    out = ["# Evaluation summary", "", "| metric | score |", "|-|-|", f"| frame accuracy | {value('frame_accuracy')} |", f"| intent accuracy | {value('intent_accuracy')} |"]
    out += ["", "## Slots", "", "| precision | recall | f1 |", "|-|-|-|", f"| {value('precision')} | {value('recall')} | {value('f1')} |"]
    if confusion is not None:
        n = {(r.truth, r.pred): r.n for r in confusion.select("truth", "pred", "n").collect()}  # the square of the labels
        labels = sorted({x for pair in n for x in pair}, key=str)
        out += ["", "## Intents", "", "| truth, predicted | " + " | ".join(map(str, labels)) + " |", "|-" * (len(labels) + 1) + "|"]
        out += [f"| {t} | " + " | ".join(str(n.get((t, p), 0)) for p in labels) + " |" for t in labels]
    return "\n".join(out) + "\n"

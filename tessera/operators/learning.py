"""Intent models and their data: splits, features, classifiers, uncertainty, review queues."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import char_grams


#: Slots of the scrambled order of a split.
SLOTS = 10007


def clean(rows: DataFrame) -> DataFrame:
    """Labelled queries without nulls, blanks, one-letter texts and repetitions."""
    return rows.where("text is not null and label is not null and length(trim(text)) >= 2").dropDuplicates(["text", "label"])


def stratified_split(rows: DataFrame, key: str, label: str, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Each label's rows in a fixed scrambled order of the key: the first share is test, the next validation.

    Rows are numbered within slots of the scrambled order and offset by the counts of the slots before, so that a
    label that holds most rows is dealt over many tasks.
    """
    slot = F.pmod(F.col(key) * F.lit(7919) + F.lit(42), F.lit(SLOTS))
    dealt = rows.withColumn("_slot", slot)
    counts = dealt.groupBy(label, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    each = W.partitionBy(label)
    before = F.sum("_n").over(each.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
    places = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_n").over(each)}).drop("_n")
    keys = [F.col(f"r.{label}").eqNullSafe(F.col(f"p.{label}")), F.col("r._slot").eqNullSafe(F.col("p._slot"))]
    numbered = dealt.withColumn("_i", F.row_number().over(W.partitionBy(label, "_slot").orderBy(key)))
    joined = numbered.alias("r").join(places.alias("p"), keys[0] & keys[1]).select("r.*", "p._before", "p._all")
    at = (F.col("_before") + F.col("_i") - 1) / F.col("_all")
    return joined.withColumn("split", F.when(at < test, "test").when(at < round(test + val, 9), "val").otherwise("train")).drop("_slot", "_i", "_before", "_all")


def classifier(kind: str = "lr", features: int = 2000, weight: str | None = None) -> Pipeline:
    """Character n-grams of 1 to 3 in at most .8 of the texts, TF-IDF and a classifier, as one pipeline over (grams, label)."""
    index = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc")
    count = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features, maxDF=0.8)
    idf, unit = IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")
    args = {"labelCol": "y"} | ({"weightCol": weight} if weight else {})
    model = {"lr": lambda: LogisticRegression(maxIter=30, **args), "rf": lambda: RandomForestClassifier(seed=42, **args), "svm": lambda: OneVsRest(labelCol="y", classifier=LinearSVC(maxIter=30))}[kind]()
    return Pipeline(stages=[index, count, idf, unit, model])


def with_chars(rows: DataFrame) -> DataFrame:
    """Rows with ``grams``, the runs of one to three characters of the text."""
    return rows.withColumn("grams", char_grams(F.col("text")))


def vote(parts: list[Column], weights: list[float]) -> Column:
    """Weighted mean of probability arrays (soft voting)."""
    total = sum(weights)

    def scaled(p: Column, w: float) -> Column:
        return F.transform(p, lambda x: x * (w / total))

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(scaled, parts, weights))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the probabilities and the number of the likeliest class."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(with_chars(rows)).withColumn("probabilities", vector_to_array("probability")).drop("grams", "tf", "tfidf", "features", "rawPrediction", "probability")


def uncertainty(p: Column) -> dict[str, Column]:
    """Entropy (of 1), missing confidence and missing margin of a distribution, and .4/.4/.2 of them."""
    n, s = F.size(p), F.sort_array(p, asc=False)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0)) / F.ln(n)
    margin = F.when(n > 1, s[0] - s[1]).otherwise(1.0)
    total = 0.4 * entropy + 0.4 * (1 - s[0]) + 0.2 * (1 - margin)
    return {"entropy": F.round(entropy, 6), "confidence": F.round(s[0], 6), "margin": F.round(margin, 6), "uncertainty": F.round(total, 6)}


def review_queue(rows: DataFrame, n: int, tie: str) -> DataFrame:
    """The n most uncertain rows."""
    return rows.orderBy(F.desc("uncertainty"), tie).limit(n)


def reviewed(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The queue without the rows that are reviewed."""
    return queue.join(done.select(key).distinct(), key, "left_anti")


def trust(uncertainty_: Column, review: float = 0.6, automatic: float = 0.3) -> Column:
    """What to do with a prediction by its uncertainty: review from the upper bound on, automatic up to the lower, else check."""
    return F.when(uncertainty_ >= review, "review").when(uncertainty_ <= automatic, "automatic").otherwise("check")


def confidence_class(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def dataset_report(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share, mean_length, distinct): one row for each label of labelled texts."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.countDistinct("text").alias("distinct"))
    total = n.agg(F.sum("n").alias("all"))
    return n.join(F.broadcast(total)).select(label, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean_length", "distinct")


def importance(model: PipelineModel, most: int = 10) -> list[tuple[str, float]]:
    """The features of greatest weight of a fitted ``classifier``: by the largest coefficient of any class, or the forest's own measure."""
    names = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        weight = last.featureImportances.toArray()
    else:
        weight = np.abs(last.coefficientMatrix.toArray()).max(axis=0)
    order = np.lexsort((names, -weight))[:most]
    return [(names[i], float(weight[i])) for i in order]


def buffer_statistics(rows: DataFrame, most: int) -> DataFrame:
    """One row over a query buffer (uncertainty) of at most ``most`` places: queries, mean, greatest and least uncertainty, and the share in use."""
    n, u = F.count(F.lit(1)), F.col("uncertainty")
    of = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.agg(n.alias("queries"), of(F.avg(u)).alias("mean"), of(F.max(u)).alias("most"), of(F.min(u)).alias("least"), F.round(n / F.lit(most), 6).alias("in_use"))


def advanced_features(text: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """Length, density, structure and, for each intent, the share of its keywords that a text holds."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n, size = F.size(w), F.greatest(F.length(text), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[?？]"))
    out = {"chars": F.length(text).cast("long"), "words": n.cast("long"), "density": F.round(n / size, 6), "questions": marks.cast("long"), "digits": F.round(F.regexp_count(text, F.lit("[0-9]")) / size, 6),
           "variety": F.when(n > 0, F.round(F.size(F.array_distinct(w)) / n, 6)).otherwise(0.0)}
    for name, keys in keywords.items():
        held = reduce(lambda a, b: a + b, [F.lower(text).contains(k).cast("int") for k in keys])
        out[f"has_{name}"] = F.round(held / F.lit(float(len(keys))), 6)
    return out


def structure_features(text: Column, names: list[str]) -> dict[str, Column]:
    """For each word how often a text holds it, and where first (from 0, by its share of the length; -1 for never)."""
    low, out = F.lower(text), {}
    for x in names:
        out[f"n_{x}"] = F.floor((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / len(x)).cast("long")
        at = F.instr(low, x)
        out[f"at_{x}"] = F.when(at > 0, F.round((at - 1) / F.length(low), 6)).otherwise(-1.0)
    return out


def weighted_concat(parts: list[Column], weights: list[float]) -> Column:
    """Feature arrays one after another, each times its weight."""
    return F.concat(*[_times(p, w) for p, w in zip(parts, weights, strict=True)])


def _times(p: Column, w: Column | float) -> Column:
    return F.transform(p, lambda x: x.cast("double") * w)


def interaction(a: Column, b: Column) -> Column:
    """All products of two feature arrays, the first array's index outermost."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double"))))


def attention(parts: list[Column]) -> Column:
    """Feature arrays of one length, added with the softmax of their mean magnitudes as weights."""
    size = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(p)
    e = [F.exp(size(p)) for p in parts]
    total = reduce(lambda a, b: a + b, e)
    scaled = [_times(p, w / total) for p, w in zip(parts, e, strict=True)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def one_hot(value: Column, names: list[str]) -> Column:
    """1 at the value's place among the names, else 0; a name that is not there has none."""
    return F.array(*[F.coalesce((value == n).cast("double"), F.lit(0.0)) for n in names])


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """A unit vector of hashed token counts, or zeros: the default where no embedding model is plugged in."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(counts, lambda x: x / length)).otherwise(counts)


# -- kernel machine, voting, interpretation ------------------------------------------------------------------------------


def fourier_features(rows: DataFrame, size: int = 256, gamma: float = 1.0, seed: int = 42, vector: str = "features", out: str = "kernel") -> DataFrame:
    """rows with ``out``: random Fourier features of a vector column, whose inner products tend to exp(-gamma |x - y|^2).

    A linear machine over them is one with a radial kernel, trained in time linear in the rows. Only the components that are set are read, each
    with a seeded row of weights.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    @F.arrow_udf("array<double>")
    def waves(x: pa.Array) -> pa.Array:
        n = len(x)
        flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((flat.shape[1], size)) * np.sqrt(2 * gamma)
        z = np.sqrt(2 / size) * np.cos(flat @ w + rng.uniform(0, 2 * np.pi, size))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(z.ravel()))

    return rows.withColumn(out, array_to_vector(waves(vector_to_array(vector))))


class Voters:
    """A logistic model, a kernel machine and a forest over the same features, whose probabilities are averaged by weight."""

    WEIGHTS = (0.7, 0.2, 0.1)

    def __init__(self, base: PipelineModel, logistic, kernel, forest, size: int, gamma: float) -> None:
        self.base, self.logistic, self.kernel, self.forest, self.size, self.gamma = base, logistic, kernel, forest, size, gamma

    @classmethod
    def fit(cls, rows: DataFrame, features: int = 2000, size: int = 256, gamma: float = 1.0) -> Voters:
        """Train on rows (text, label): the features once, then three models; the kernel machine is logistic, so its probabilities are calibrated."""
        whole = classifier("lr", features)
        base = Pipeline(stages=whole.getStages()[:-1]).fit(with_chars(rows))
        ready = fourier_features(base.transform(with_chars(rows)).select("features", "y"), size, gamma).cache()
        try:
            logistic = LogisticRegression(maxIter=30, labelCol="y").fit(ready)
            kernel = LogisticRegression(maxIter=50, regParam=1e-3, labelCol="y", featuresCol="kernel").fit(ready)
            forest = RandomForestClassifier(seed=42, labelCol="y").fit(ready)
        finally:
            ready.unpersist()
        return cls(base, logistic, kernel, forest, size, gamma)

    @property
    def labels(self) -> list[str]:
        return list(self.base.stages[0].labels)

    def predict(self, rows: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
        """rows with ``p_lr``, ``p_kernel``, ``p_rf``, the vote's ``probabilities`` and the ``predicted`` label."""
        from pyspark.ml.functions import vector_to_array

        at = fourier_features(self.base.transform(with_chars(rows)).drop("y", "tf", "tfidf", "grams"), self.size, self.gamma)
        for name, model in (("lr", self.logistic), ("kernel", self.kernel), ("rf", self.forest)):
            at = model.transform(at).withColumn(f"p_{name}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        known = len(self.labels)
        at = at.withColumn("probabilities", F.slice(vote([F.col("p_lr"), F.col("p_kernel"), F.col("p_rf")], list(weights)), 1, known))
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return at.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.labels)), best)).drop("features", "kernel")


def permutation_importance(rows: DataFrame, names: list[str], predicted, truth: str, seed: int = 42) -> DataFrame:
    """(feature, accuracy, drop): how much the share of right predictions falls when a feature's values change rows.

    ``predicted`` gives a prediction column from the feature columns by name. Rows are dealt at random and each takes the value of the next row
    of its slot, so that a feature's values move while their distribution stays; no slot grows with the table, and all features are scored in one pass.
    """
    n = max(1, rows.count() // 1000)
    dealt = rows.withColumns({"_slot": F.floor(F.rand(seed) * n), "_at": F.rand(seed + 1)})
    w = W.partitionBy("_slot").orderBy("_at")
    moved = {f"_moved_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) for c in names}
    both = dealt.withColumns(moved)
    right = lambda changed: F.avg((predicted({c: F.col(f"_moved_{c}" if c == changed else c) for c in names}) == F.col(truth)).cast("double"))
    got = both.agg(right(None).alias("_all"), *[right(c).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("accuracy")) for c in names]))
    return got.select("_all", each.alias("x")).select("x.feature", F.round("x.accuracy", 6).alias("accuracy"), F.round(F.col("_all") - F.col("x.accuracy"), 6).alias("drop"))


def decision_rules(rows: DataFrame, names: list[str], label: str, depth: int = 3) -> DataFrame:
    """(rule, label, rows): the paths of a small tree that stands in for a model, fitted to its predictions (a numeric label column).

    The tree has at most 2 ** depth leaves, so its paths are read on the driver.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=names, outputCol="x").transform(rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("y")))
    root = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=depth, seed=42).fit(ready)._call_java("rootNode")
    paths: list[tuple[str, float, int]] = []

    def walk(node, held: list[str]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            paths.append((" and ".join(held) or "true", float(node.prediction()), int(sum(node.impurityStats().stats()))))
            return
        split = node.split()
        test = f"{names[split.featureIndex()]} <= {round(split.threshold(), 6)}"
        walk(node.leftChild(), [*held, test])
        walk(node.rightChild(), [*held, test.replace("<=", ">")])

    walk(root, [])
    return rows.sparkSession.createDataFrame(paths, "rule string, label double, rows long")

"""Text categorisation, tabular classifiers, cross-validation, word vectors, regression, on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, HashingTF, Imputer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.search import BOX_WIDTH, nearest_of, nearest_points
from tamarisk.plans.scale import lookup, written

CLASSIFIERS = {
    "nb": lambda: NaiveBayes(), "lr": lambda: LogisticRegression(maxIter=20), "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=10)),
    "tree": lambda: DecisionTreeClassifier(seed=7), "forest": lambda: RandomForestClassifier(numTrees=20, seed=7), "gbt": lambda: GBTClassifier(maxIter=10, seed=7),
    "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=7)), "elastic": lambda: LogisticRegression(maxIter=50, regParam=1e-4, elasticNetParam=0.15),
}


class TextCategorizer:
    """TF-IDF of n-grams of words (or ``characters``) and a classifier; labels are numbered in alphabetical order.

    Features are hashed, so no vocabulary is collected, unless ``max_features`` bounds one: then the most frequent n-grams count that are in at least
    ``min_df`` documents and in at most a share ``max_df`` of them, and ``weights`` can name them.
    """

    def __init__(self, classifier: str = "nb", ngrams: int = 1, stop_words: bool = True, features: int = 1 << 16, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, characters: bool = False):
        self.classifier, self.ngrams, self.stop_words, self.features, self.min_df, self.max_df, self.max_features, self.characters = classifier, ngrams, stop_words, features, min_df, max_df, max_features, characters
        self.model: PipelineModel | None = None

    def _stages(self) -> list:
        stages: list = []
        if self.characters:
            columns = []
            for n in range(1, self.ngrams + 1):
                # The characters go through a lambda, so that a text is cut once and not for every n-gram.
                stages.append(SQLTransformer(statement=f"SELECT *, flatten(transform(array(split(lower(text), '')), cs -> CASE WHEN size(cs) >= {n} THEN transform(sequence(1, greatest(size(cs) - {n - 1}, 1)), i -> array_join(slice(cs, i, {n}), '')) ELSE array() END)) AS c{n} FROM __THIS__"))
                columns.append(f"c{n}")
            words = columns[0]
        else:
            stages.append(RegexTokenizer(inputCol="text", outputCol="w0", pattern="[^\\p{L}\\p{N}]+", minTokenLength=2))
            words = "w0"
            if self.stop_words:
                stages.append(StopWordsRemover(inputCol=words, outputCol="w", stopWords=StopWordsRemover.loadDefaultStopWords("english")))
                words = "w"
            columns = [words]
            for n in range(2, self.ngrams + 1):
                stages.append(NGram(n=n, inputCol=words, outputCol=f"g{n}"))
                columns.append(f"g{n}")
        if len(columns) > 1:
            stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(columns)}) AS all_terms FROM __THIS__"))
            words = "all_terms"
        if self.max_features is None:
            return [*stages, HashingTF(inputCol=words, outputCol="tf", numFeatures=self.features), IDF(inputCol="tf", outputCol="features", minDocFreq=self.min_df)]
        return [*stages, CountVectorizer(inputCol=words, outputCol="tf", vocabSize=self.max_features, minDF=self.min_df, **({"maxDF": self.max_df} if self.max_df < 1 else {})), IDF(inputCol="tf", outputCol="features")]

    def train(self, df: DataFrame) -> TextCategorizer:
        """``df`` has label and text; rows with a null are left out."""
        clf = CLASSIFIERS[self.classifier]()
        labels = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip")
        self.model = Pipeline(stages=[labels, *self._stages(), clf.setLabelCol("y")]).fit(df.where("label IS NOT NULL AND text IS NOT NULL"))
        return self

    def categorize(self, df: DataFrame) -> DataFrame:
        """``df`` with a predicted label; null texts are left out."""
        assert self.model is not None
        names = F.array(*[F.lit(x) for x in self.model.stages[0].labels])
        m = PipelineModel(stages=self.model.stages[1:])
        out = m.transform(df.where("text IS NOT NULL"))
        return out.select(*df.columns, names[F.col("prediction").cast("int")].alias("predicted"))

    def class_probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities``, a map from every label to its probability; ``ValueError`` for a classifier that has none. Null texts are left out."""
        assert self.model is not None
        m = PipelineModel(stages=self.model.stages[1:])
        out = m.transform(df.where("text IS NOT NULL"))
        if "probability" not in out.columns:
            raise ValueError(f"{self.classifier} gives no probabilities")
        names = F.array(*[F.lit(x) for x in self.model.stages[0].labels])
        return out.select(*df.columns, F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))

    def weights(self, k: int = 10) -> DataFrame:
        """label, rank, term, weight: the ``k`` terms that speak most for each label, of a bayes or logistic model with ``max_features``.

        The model is a table of labels and features of bounded size, which the driver holds. A bayes model's weight is the logarithm of a term's share in a label
        over its mean share.
        """
        assert self.model is not None
        vocabulary = next((st.vocabulary for st in self.model.stages if isinstance(st, CountVectorizerModel)), None)
        if vocabulary is None:
            raise ValueError("hashed features have no names; set max_features")
        last, labels = self.model.stages[-1], self.model.stages[0].labels
        w = last.theta.toArray() if hasattr(last, "theta") else last.coefficientMatrix.toArray()
        if hasattr(last, "theta"):
            w = w - np.log(np.exp(w).mean(axis=0, keepdims=True))
        elif len(w) == 1:
            w = np.vstack([-w, w])
        rows = [(label, r + 1, vocabulary[j], float(w[i, j])) for i, label in enumerate(labels) for r, j in enumerate(sorted(range(len(vocabulary)), key=lambda j: (-w[i, j], vocabulary[j]))[:k])]
        return SparkSession.active().createDataFrame(rows, "label string, rank int, term string, weight double")

    def test(self, df: DataFrame) -> DataFrame:
        """One row (n, accuracy) over the rows whose label was seen in training."""
        assert self.model is not None
        known = self.categorize(df.where(F.col("label").isin(*self.model.stages[0].labels)))
        return known.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))

    def save(self, path: str) -> None:
        assert self.model is not None
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> TextCategorizer:
        self.model = PipelineModel.load(path)
        return self


def features(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """y (alphabetical label number) and scaled features, nulls filled with the mean; rows without a label are left out."""
    t = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("string").alias("label"))
    stages = [Imputer(inputCols=list(columns), outputCols=[f"{c}_f" for c in columns]), VectorAssembler(inputCols=[f"{c}_f" for c in columns], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc")]
    return Pipeline(stages=stages).fit(t).transform(t).select("y", "features")


def hold_out(data: DataFrame, classifier: str, share: float = 0.2, seed: int = 7919) -> float:
    """Accuracy on a random ``share`` of the rows; besides CLASSIFIERS there are ``lda`` and ``knn``."""
    train, test = data.randomSplit([1 - share, share], seed)
    if classifier in ("lda", "knn"):
        predicted = discriminant(train, test) if classifier == "lda" else nearest(train, test)
        return float(predicted.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] or 0.0)
    model = CLASSIFIERS[classifier]().setLabelCol("y").fit(train)
    return MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(model.transform(test))


#: Features that ``discriminant`` takes; the sums of their products are one row for each class.
MAX_FEATURES = 200


def discriminant(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` (y, features) with the prediction of a linear discriminant: classes with means of their own and one covariance.

    One aggregation of sums and products; the scores are linear expressions of the features.
    """
    x = vector_to_array("features")
    first = train.select(F.size(x)).first()
    width = first[0] if first else 0
    if width > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    rows = train.withColumn("x", x).groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]).orderBy("y").collect()
    n = sum(r.n for r in rows)
    if not n:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    within, means = np.zeros((width, width)), []
    for r in rows:
        m = np.array([r[f"s{i}"] for i in range(width)]) / r.n
        means.append(m)
        q = np.zeros((width, width))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        within += q - r.n * np.outer(m, m)
    inverse = np.linalg.pinv(within / max(n - len(rows), 1) + 1e-9 * np.eye(width))
    scores = []
    for r, m in zip(rows, means):
        w = inverse @ m
        scores.append(F.struct((sum((F.col("x")[i] * float(w[i]) for i in range(width)), F.lit(0.0)) + F.lit(float(np.log(r.n / n) - m @ w / 2))).alias("score"), F.lit(r.y).alias("y")))
    best = F.array_max(F.array(*scores))["y"]
    return test.withColumn("x", x).withColumn("prediction", best).drop("x")


def nearest(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """``test`` (y, features) with the most frequent class of the ``k`` nearest rows of ``train`` (ties: the smaller class); exact, see ``search.nearest_of``.

    Rows with the same features count one by one, but are sought once: of the ``k`` nearest rows each is among the ``k`` first of its features, and these among the ``k``
    nearest features, ranked by their first row. Few features are sought in boxes, see ``search.nearest_points``.
    """
    numbered = lambda t: written(t.select("y", vector_to_array("features").alias("embedding")).withColumn("vec_id", F.monotonically_increasing_id()))
    known, asked = numbered(train), numbered(test).withColumn("vec_id", -F.col("vec_id") - 1)
    first = known.withColumn("n", F.expr("row_number() OVER (PARTITION BY embedding ORDER BY vec_id)")).where(F.col("n") <= k)
    points = written(first.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.collect_list(F.struct(F.col("vec_id").alias("row"), F.col("y").alias("vote"))).alias("rows")))
    places = written(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")))
    width = points.select(F.size("embedding")).first()
    near = nearest_points(points, places, k) if width and 0 < width[0] <= BOX_WIDTH else nearest_of(points, places, k)
    rows = near.join(points.select("vec_id", "rows"), "vec_id").select("query", "distance", F.inline("rows"))
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), row)")).where(F.col("rank") <= k)
    votes = ranked.groupBy("query", "vote").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy(F.col("query").alias("vec_id")).agg(F.max(F.struct("n", (-F.col("vote")).alias("v")))["v"].alias("v"))
    return lookup(asked, places.join(top, "vec_id").select("embedding", "v"), ["embedding"]).select("y", (-F.col("v")).alias("prediction"))


def cross_validated(data: DataFrame, classifier: str, folds: int = 5, grid: dict[str, Sequence] | None = None, seed: int = 7919) -> tuple[float, float, dict]:
    """Mean and standard deviation of the accuracy of the best settings, and these settings."""
    clf = CLASSIFIERS[classifier]().setLabelCol("y")
    b = ParamGridBuilder()
    for name, values in (grid or {}).items():
        b = b.addGrid(getattr(clf, name), list(values))
    maps = b.build()
    cv = CrossValidator(estimator=clf, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=folds, seed=seed, parallelism=2).fit(data)
    best = max(range(len(maps)), key=lambda i: cv.avgMetrics[i])
    return cv.avgMetrics[best], cv.stdMetrics[best], {p.name: v for p, v in maps[best].items()}


def random_search(data: DataFrame, classifier: str, ranges: dict[str, tuple[float, float]], tries: int = 5, folds: int = 3, seed: int = 7919) -> tuple[float, dict, int]:
    """Mean accuracy and settings of the best of ``tries`` settings drawn from ranges (whole numbers where both ends are), and how many were tried."""
    rng = random.Random(seed)
    clf = CLASSIFIERS[classifier]().setLabelCol("y")
    maps = [{getattr(clf, name): rng.randint(a, b) if isinstance(a, int) and isinstance(b, int) else rng.uniform(a, b) for name, (a, b) in ranges.items()} for _ in range(tries)]
    cv = CrossValidator(estimator=clf, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=folds, seed=seed, parallelism=2).fit(data)
    best = max(range(len(maps)), key=lambda i: cv.avgMetrics[i])
    return cv.avgMetrics[best], {p.name: v for p, v in maps[best].items()}, len(maps)


def importances(data: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Importance of each column in a random forest, largest first."""
    m = CLASSIFIERS["forest"]().setLabelCol("y").fit(data)
    return sorted(zip(columns, m.featureImportances.toArray().tolist()), key=lambda x: -x[1])


def word_vectors(docs: DataFrame, text: str = "text", size: int = 50, min_count: int = 5, seed: int = 7):
    """A word2vec model of the lower-cased words."""
    words = docs.where(F.col(text).isNotNull()).select(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return Word2Vec(vectorSize=size, minCount=min_count, inputCol="words", outputCol="v", seed=seed, maxIter=1, numPartitions=4).fit(words)


def linear_fit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """term, estimate, std_error, t_value, p_value of a least-squares fit with intercept; rows with a null are left out."""
    t = df.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    m = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=list(xs), outputCol="features").transform(t))
    s = m.summary
    rows = list(zip([*xs, "(intercept)"], [*m.coefficients.toArray().tolist(), m.intercept], s.coefficientStandardErrors, s.tValues, s.pValues))
    return df.sparkSession.createDataFrame([(n, float(a), float(b), float(c), float(d)) for n, a, b, c, d in rows], "term string, estimate double, std_error double, t_value double, p_value double")


def ablation(df: DataFrame, columns: Sequence[str], label: str, classifier: str = "lr") -> DataFrame:
    """Held-out accuracy with the first column, the first two, and so on: (columns, accuracy)."""
    rows = [(", ".join(columns[: k + 1]), float(hold_out(features(df, columns[: k + 1], label), classifier))) for k in range(len(columns))]
    return df.sparkSession.createDataFrame(rows, "columns string, accuracy double")


def column_names(columns: Sequence[str], y: int = -1, xs: Sequence[int] | None = None) -> tuple[str, list[str]]:
    """Names of columns given by number, from 1, or from -1 for the last; by default the last depends on all others."""
    at = lambda i: columns[i - 1 if i > 0 else i]
    if any(i == 0 or abs(i) > len(columns) for i in [y, *(xs or [])]):
        raise ValueError(f"columns are numbered from 1 to {len(columns)}, or from -1")
    return at(y), [at(i) for i in xs] if xs is not None else [c for c in columns if c != at(y)]


def fit_columns(df: DataFrame, y: int = -1, xs: Sequence[int] | None = None) -> DataFrame:
    """``linear_fit`` of columns given by number."""
    return linear_fit(df, *column_names(df.columns, y, xs))


def logistic_fit(df: DataFrame, y: str, xs: Sequence[str], quasi: bool = False) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(term, estimate, std_error, z_value, p_value) of a logistic regression of a 0/1 column, and a function that adds the fitted ``probability`` to rows.

    ``quasi``: standard errors are scaled by the root of the dispersion that the Pearson residuals show. Rows with a null are left out.
    """
    t = df.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    data = VectorAssembler(inputCols=list(xs), outputCol="features")
    m = GeneralizedLinearRegression(labelCol="y", family="binomial", link="logit", maxIter=50, tol=1e-10).fit(data.transform(t))
    s = m.summary
    scale = 1.0
    if quasi:
        scale = float((s.residuals("pearson").agg(F.sum(F.pow("pearsonResiduals", 2))).first()[0] / max(s.residualDegreeOfFreedom, 1)) ** 0.5)
    terms = [*xs, "(intercept)"]
    estimates = [*m.coefficients.toArray().tolist(), m.intercept]
    rows = [(n, float(e), float(se) * scale, float(e / (se * scale)), math.erfc(abs(e / (se * scale)) / 2**0.5)) for n, e, se in zip(terms, estimates, s.coefficientStandardErrors)]
    z = sum((F.coalesce(F.col(x).cast("double"), F.lit(None)) * float(e) for x, e in zip(xs, estimates)), F.lit(float(estimates[-1])))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, p_value double"), lambda rows_: rows_.withColumn("probability", 1 / (1 + F.exp(-z)))

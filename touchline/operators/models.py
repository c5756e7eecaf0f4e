"""Three-way outcome models (away win 0, draw 1, home win 2): fit, save, load, predict, evaluate, compare.

Logistic regression is one Spark ML pipeline, scaler included. Forests and boosters are tables of nodes (see trees): soft-max boosting by second derivatives stands
in for one boosting library, symmetric trees over ordered target statistics for another. The type catboost takes text columns among its features as
categories, unencoded; the other types want numbers.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from touchline.operators import encoding, features, isotonic, trees
from touchline.sources import files

SEED = 42
LABELS = (0, 1, 2)
MODEL_TYPES = ("logistic_regression", "random_forest", "xgboost", "catboost")
#: Parameters that the forest's search draws from; no depth is no limit.
FOREST_GRID = {"trees": (100, 200, 500), "depth": (10, 20, None), "least_split": (2, 5, 10), "least_leaf": (1, 2, 4)}
#: What the boosters are grown by: depth, size of a step, penalty of squared leaf values, least second derivative in a leaf.
BOOSTING = {"xgboost": {"depth": 6, "step": 0.3, "l2": 1.0, "least_weight": 1.0}, "catboost": {"depth": 6, "step": 0.1, "l2": 3.0, "symmetric": True}}
#: Models that are fitted at one time in a search, a calibration or a comparison.
PARALLEL = 4
EPS = 1e-15


def _proba(values: list[Column], like: DataFrame) -> DataFrame:
    """like with p_0, p_1, p_2 scaled to sum 1 (equal where all are 0) and prediction."""
    total = sum(values[1:], values[0])
    out = like.withColumns({f"p_{i}": F.when(total > 0, v / total).otherwise(F.lit(1 / 3)) for i, v in enumerate(values)})
    return out.withColumn("prediction", F.when((F.col("p_2") >= F.col("p_1")) & (F.col("p_2") >= F.col("p_0")), 2).when(F.col("p_1") >= F.col("p_0"), 1).otherwise(0))


@dataclass
class MatchPredictor:
    """An outcome model of one type over the named features. options: of trees.fit_forest or trees.fit_boosted."""

    model_type: str
    features: list[str]
    options: dict[str, Any] = field(default_factory=dict)
    pipeline: PipelineModel | None = None
    tree_model: trees.TreeModel | None = None
    #: Text features and what their categories came with (catboost).
    text: list[str] = field(default_factory=list)
    known: DataFrame | None = None

    def __post_init__(self):
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type: {self.model_type}")

    def _fit_regression(self, train: DataFrame) -> PipelineModel:
        """The ridge penalty of one half of the squared weights against the summed loss, as 1 / n against the mean."""
        n = train.count()
        lr = LogisticRegression(featuresCol="features", family="multinomial", maxIter=1000, tol=1e-9, regParam=1.0 / n, standardization=False)
        scale = StandardScaler(inputCol="raw_features", outputCol="sample_features", withMean=True)
        # Spark divides by the sample's deviation; z-scores here are by the population's, as in features.scaler.
        to_population = Vectors.dense([math.sqrt(n / max(1, n - 1))] * len(self.features))
        population = ElementwiseProduct(inputCol="sample_features", outputCol="features", scalingVec=to_population)
        return Pipeline(stages=[VectorAssembler(inputCols=self.features, outputCol="raw_features"), scale, population, lr]).fit(train)

    def fit(self, train: DataFrame, search: bool | None = None, combinations: int = 10, folds: int = 5, grid: dict[str, tuple] | None = None) -> MatchPredictor:
        """Fit on rows with match_id, the features and label. A forest is searched (cross-validated choice among ``combinations`` draws of the grid) unless options are given."""
        train = train.withColumn("label", F.col("label").cast("double")).cache()
        try:
            if train.isEmpty():
                raise ValueError("no rows to fit on")
            if self.model_type == "logistic_regression":
                self.pipeline = self._fit_regression(train)
            elif self.model_type == "random_forest":
                if search is None:
                    search = not self.options
                if search:
                    scores = search_forest(self.features, train, combinations, folds, grid or FOREST_GRID, self.options)
                    self.options = self.options | min(scores, key=lambda x: x[0])[1]
                self.tree_model = trees.fit_forest(train, self.features, **self.options)
            else:
                self.text = [f for f in self.features if self.model_type == "catboost" and train.schema[f].dataType == StringType()]
                rows = train
                if self.text:
                    counts = encoding.statistics(train, self.text)
                    self.known = train.sparkSession.createDataFrame(counts.collect(), encoding.STATISTICS)  # a row a category
                    rows = encoding.ordered(train, self.text)
                self.tree_model = trees.fit_boosted(rows, self._tree_features(), **(BOOSTING[self.model_type] | self.options))
        finally:
            train.unpersist()
        return self

    def _tree_features(self) -> list[str]:
        return [n for f in self.features for n in (encoding.names([f]) if f in self.text else [f])]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p_0, p_1, p_2 and prediction."""
        out = rows.drop("prediction")
        if self.pipeline is not None:
            made = ["features", "sample_features", "raw_features", "rawPrediction", "probability", "prediction"]
            out = self.pipeline.transform(out).withColumn("__p", vector_to_array("probability")).drop(*made)
        elif self.tree_model.below is not None:
            own = files.written(out.withColumn("__row", F.monotonically_increasing_id()))
            scored = self.tree_model.scored(own, "__row").withColumnRenamed("scores", "__p")
            out = own.join(scored, "__row", "left").drop("__row")
        else:
            own = encoding.encoded(out, self.known, self.text) if self.text else out
            out = own.withColumn("__p", self.tree_model.scores()).drop(*encoding.names(self.text))
        return _proba([F.get("__p", F.lit(i)) for i in LABELS], out).drop("__p")

    def predict_match(self, row: DataFrame) -> DataFrame:
        """home, draw and away probabilities, and as percentages."""
        out = self.predict(row).select(F.col("p_2").alias("home"), F.col("p_1").alias("draw"), F.col("p_0").alias("away"))
        return out.withColumns({f"{c}_percent": F.format_string("%.2f%%", F.col(c) * 100) for c in ("home", "draw", "away")})

    def importance(self, spark: SparkSession) -> DataFrame:
        """Feature and Importance: shares of the gain of a forest's or booster's splits (largest first), or the weights for an away win (largest size first)."""
        if self.pipeline is not None:
            values = self.pipeline.stages[-1].coefficientMatrix.toArray()[0].tolist()
        else:
            each = dict(zip(self.tree_model.names, self.tree_model.importance(), strict=True))
            values = [sum(each[n] for n in (encoding.names([f]) if f in self.text else [f])) for f in self.features]
        out = spark.createDataFrame(list(zip(self.features, values, strict=True)), "Feature string, Importance double")
        return out.orderBy(F.abs("Importance").desc(), "Feature")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The table of nodes of a forest or booster."""
        return self.tree_model.nodes(spark)

    def save(self, spark: SparkSession, path: str) -> None:
        """All that predicts, the feature list too."""
        about = {"model_type": self.model_type, "features": self.features, "options": self.options, "text": self.text}
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/model_0")
        else:
            m = self.tree_model
            about |= {"names": m.names, "kind": m.kind, "classes": m.classes}
            m.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
            if self.text:
                self.known.write.mode("overwrite").parquet(f"{path}/categories")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MatchPredictor:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = MatchPredictor(about["model_type"], about["features"], about["options"], text=about["text"])
        if "names" not in about:
            out.pipeline = PipelineModel.load(f"{path}/model_0")
            return out
        out.tree_model = trees.TreeModel.of(spark.read.parquet(f"{path}/nodes"), about["names"], about["kind"], about["classes"])
        if out.text:
            out.known = spark.read.parquet(f"{path}/categories")
        return out


def side_by_side(spark: SparkSession, f: Callable[[Any], Any], jobs: Iterable[Any]) -> list[Any]:
    """f of each, a few at a time: fits are many short passes that leave cores idle."""
    with ThreadPool(PARALLEL) as pool:
        return pool.map(inheritable_thread_target(spark)(f), jobs, chunksize=1)


def draws(combinations: int, choices: dict[str, tuple]) -> list[dict[str, Any]]:
    """A seeded draw of combinations of a grid, without repeats."""
    every = [dict(zip(choices, values, strict=True)) for values in itertools.product(*choices.values())]
    return random.Random(SEED).sample(every, min(combinations, len(every)))


def search_forest(names: list[str], train: DataFrame, combinations: int, folds: int, choices: dict[str, tuple], options: dict[str, Any] | None = None) -> list[tuple[float, dict[str, Any]]]:
    """(mean log loss over stratified folds, options) of each drawn combination. Forests are fitted a few at a time; each is a few passes over its rows."""
    dealt = features.with_folds(train, folds).cache()

    def loss(job: tuple[dict[str, Any], int]) -> float:
        own, i = job
        model = MatchPredictor("random_forest", names, (options or {}) | own).fit(dealt.filter(F.col("fold") != i), search=False)
        got = evaluate(model.predict(dealt.filter(F.col("fold") == i))).first()["log_loss"]
        if model.tree_model.below is not None:  # fifty of them would fill the folder
            files.discard(model.tree_model.below)
        return got

    try:
        drawn = draws(combinations, choices)
        got = side_by_side(train.sparkSession, loss, [(own, i) for own in drawn for i in range(folds)])
    finally:
        dealt.unpersist()
    mean = lambda x: sum(v for v in x if v is not None) / max(1, sum(v is not None for v in x))
    return [(mean(got[i * folds : (i + 1) * folds]), own) for i, own in enumerate(drawn)]


def log_loss(label: Column | str = "label") -> Column:
    own = F.when(F.col("label") == 0, F.col("p_0")).when(F.col("label") == 1, F.col("p_1")).otherwise(F.col("p_2"))
    return -F.avg(F.log(F.least(F.greatest(own, F.lit(EPS)), F.lit(1 - EPS))))


def accuracy() -> Column:
    return F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0))


def evaluate(predicted: DataFrame) -> DataFrame:
    """log_loss and accuracy of predicted rows, both of the same model."""
    return predicted.agg(log_loss().alias("log_loss"), accuracy().alias("accuracy"))


@dataclass
class Calibrated:
    """Pairs of a predictor, fitted without one fold, and its isotonic corrections, one a class, fitted on that fold. Their probabilities are averaged."""

    pairs: list[tuple[MatchPredictor, list[isotonic.Isotonic]]]

    @staticmethod
    def fit(model_type: str, names: list[str], train: DataFrame, folds: int = 5, **options: Any) -> Calibrated:
        dealt = features.with_folds(train, folds).cache()

        def pair(i: int) -> tuple[MatchPredictor, list[isotonic.Isotonic]]:
            own = MatchPredictor(model_type, names, options).fit(dealt.filter(F.col("fold") != i))
            held = own.predict(dealt.filter(F.col("fold") == i)).select("label", "p_0", "p_1", "p_2").cache()
            try:
                return own, [isotonic.fit(held, F.col(f"p_{k}"), F.col("label") == k) for k in LABELS]
            finally:
                held.unpersist()

        try:
            return Calibrated(side_by_side(train.sparkSession, pair, range(folds)))
        finally:
            dealt.unpersist()

    def each(self, rows: DataFrame) -> DataFrame:
        """rows with c_i_k for each pair i and class k: corrected and scaled to sum one, equal where all are 0."""
        out = rows
        for i, (own, _) in enumerate(self.pairs):
            out = own.predict(out).withColumns({f"__p_{i}_{k}": F.col(f"p_{k}") for k in LABELS}).drop("p_0", "p_1", "p_2", "prediction")
        made = [f"__p_{i}_{k}" for i in range(len(self.pairs)) for k in LABELS]
        out = out.withColumn("__c", isotonic.corrected([f for _, own in self.pairs for f in own], [F.col(c) for c in made])).drop(*made)
        for i in range(len(self.pairs)):
            c = [F.coalesce(F.get("__c", F.lit(i * len(LABELS) + k)), F.lit(0.0)) for k in LABELS]
            total = c[0] + c[1] + c[2]
            out = out.withColumns({f"c_{i}_{k}": F.when(total > 0, c[k] / total).otherwise(1 / 3) for k in LABELS})
        return out.drop("__c")

    def predict(self, rows: DataFrame) -> DataFrame:
        out, n = self.each(rows), len(self.pairs)
        made = [f"c_{i}_{k}" for i in range(n) for k in LABELS]
        return _proba([sum((F.col(f"c_{i}_{k}") for i in range(1, n)), F.col(f"c_0_{k}")) / n for k in LABELS], out).drop(*made)


def compare_models(
    train: DataFrame, test: DataFrame, names: list[str], types: tuple[str, ...] = MODEL_TYPES, raw: tuple[DataFrame, DataFrame, list[str]] | None = None,
    options: dict[str, dict[str, Any]] | None = None, **search: Any,
) -> DataFrame:
    """model, log_loss, accuracy: a row for each model type, fitted and evaluated side by side; logistic regression is calibrated, the forest searched. raw: train, test and features of catboost, with its categories unencoded.

    options: of a type's predictor; search: of the forest's search (combinations, folds, grid).
    """

    def row(kind: str) -> tuple[str, float | None, float | None]:
        own_train, own_test, own = raw if raw and kind == "catboost" else (train, test, names)
        given = (options or {}).get(kind, {})
        if kind == "logistic_regression":
            fitted = Calibrated.fit(kind, own, own_train, **given)
        else:
            more = {"search": True} | search if kind == "random_forest" else {}
            fitted = MatchPredictor(kind, own, given).fit(own_train, **more)
        return (kind, *evaluate(fitted.predict(own_test)).first())

    return train.sparkSession.createDataFrame(side_by_side(train.sparkSession, row, types), "model string, log_loss double, accuracy double")


def regression_gradient(model: MatchPredictor, train: DataFrame) -> DataFrame:
    """label, largest: the largest size of the penalised loss's gradient by a class's weights and intercept, over the training rows in one aggregate. 0 at the optimum."""
    w = model.pipeline.stages[-1].coefficientMatrix.toArray()
    scaled = model.pipeline.transform(train.withColumn("label", F.col("label").cast("double")))
    x = vector_to_array("features")
    rows = scaled.select("label", vector_to_array("probability").alias("p"), x.alias("x"))
    parts = []
    for k in LABELS:
        error = F.col("p")[k] - (F.col("label") == k).cast("double")
        parts.append(F.array(*[F.sum(error * F.col("x")[i]) + F.lit(float(w[k, i])) for i in range(w.shape[1])], F.sum(error)).alias(f"g_{k}"))
    one = rows.agg(*parts, F.count("*").alias("n"))
    size = lambda k: F.array_max(F.transform(f"g_{k}", lambda g: F.abs(g))) / F.col("n")
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), size(k).alias("largest")) for k in LABELS])).alias("s")).select("s.*")


def regression_scores(model: MatchPredictor, rows: DataFrame, train: DataFrame, id_col: str = "match_id") -> DataFrame:
    """id, p_0, p_1, p_2 from the weights alone, as an expression: z-scores by the training rows' mean and deviation, then the soft-max."""
    last = model.pipeline.stages[-1]
    fitted, w, b = features.scaler(train, model.features), last.coefficientMatrix.toArray(), last.interceptVector.toArray()
    z = [features.standardized(f, fitted) for f in model.features]
    m = [sum((F.lit(float(w[k, i])) * z[i] for i in range(len(z))), F.lit(float(b[k]))) for k in LABELS]
    top = F.greatest(*m)
    e = [F.exp(v - top) for v in m]
    return rows.select(id_col, *[(v / (e[0] + e[1] + e[2])).alias(f"p_{k}") for k, v in enumerate(e)])

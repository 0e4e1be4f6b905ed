"""Classification of documents by their vectors: PCA and one model per label, grouped folds, importance.

``newton`` are trees boosted by gradients and hessians (``boosting``), ``boosted`` are Spark's
own, of first order; ``rbf`` is a support vector machine on random Fourier features of the
Gaussian kernel. No equality of their figures is claimed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.boosting import BoostedModel, NewtonBoost
from docketry.operators.kernel import KernelModel, KernelSVC
from docketry.operators.sampler import Space, Trial, sampled

MODELS = {
    "logistic": lambda y: LogisticRegression(featuresCol="x", labelCol=y, maxIter=30),
    "forest": lambda y: RandomForestClassifier(featuresCol="x", labelCol=y, numTrees=20, seed=7),
    "boosted": lambda y: GBTClassifier(featuresCol="x", labelCol=y, maxIter=10, seed=7),
    "newton": lambda y: NewtonBoost([y]),
    "svm": lambda y: LinearSVC(featuresCol="x", labelCol=y, maxIter=30),
    "rbf": KernelSVC,
}


def split(group: str, parts: tuple[int, int, int] = (70, 15, 15)) -> Column:
    """train, validation or test by a hash of the document, so a document's segments stay together."""
    h = F.pmod(F.xxhash64(F.lit("split"), group), F.lit(sum(parts)))
    return F.when(h < parts[0], "train").when(h < parts[0] + parts[1], "validation").otherwise("test")


def fold(group: str, folds: int = 3) -> Column:
    """A document's fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), group), F.lit(folds)).cast("int")


def dimensions(features: int, rows: int, most: int = 512) -> list[int]:
    """Powers of two up to the features, ``most`` and two thirds of the rows."""
    limit = min(features, most, rows * 2 // 3)
    return [1 << k for k in range(1, limit.bit_length()) if 1 << k <= limit]


@dataclass
class Fitted:
    """The reduction and one model per label; a label with one class in training is that class."""

    reduction: Model
    models: dict[str, Model | float]

    def scores(self, rows: DataFrame, vector: str) -> DataFrame:
        """``rows`` with ``score_<label>`` from 0 to 1."""
        return self.scored(self.reduced(rows, vector)).drop("x")

    def reduced(self, rows: DataFrame, vector: str) -> DataFrame:
        """``rows`` with their components ``x``."""
        return self.reduction.transform(rows.withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))).drop("v")

    def scored(self, out: DataFrame) -> DataFrame:
        """Rows of components ``x`` with ``score_<label>``."""
        for label, m in self.models.items():
            if isinstance(m, float):
                out = out.withColumn(f"score_{label}", F.lit(m))
                continue
            out = m.transform(out)
            score = F.get(vector_to_array("probability"), 1) if "probability" in out.columns else 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))
            out = out.withColumn(f"score_{label}", score).drop("rawPrediction", "probability", "prediction")
        return out


def fit(rows: DataFrame, vector: str, labels: list[str], kind: str = "logistic", dims: int = 8, params: dict | None = None) -> Fitted:
    """Fit PCA on the rows, then a binary model of each label; ``params`` are set on the model of this kind."""
    ready = rows.withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    reduction = Pipeline(stages=[PCA(k=dims, inputCol="v", outputCol="x")]).fit(ready)
    reduced = reduction.transform(ready).drop("v").cache()
    rates = reduced.agg(*(F.avg(F.col(y).cast("double")).alias(y) for y in labels)).first()
    models = {y: float(rates[y]) if rates[y] in (0.0, 1.0) else MODELS[kind](y).setParams(**params or {}).fit(reduced.withColumn(y, F.col(y).cast("double"))) for y in labels}
    reduced.unpersist()
    return Fitted(reduction, models)


def cross_entropy(rows: DataFrame, labels: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, n, loss): mean cross-entropy of the scores."""
    within = lambda p: F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    each = F.array(*(F.struct(F.lit(y).alias("label"), F.col(y).cast("double").alias("y"), within(F.col(f"score_{y}")).alias("p")) for y in labels))
    long = rows.select(*by, F.explode(each).alias("e")).select(*by, "e.*")
    lost = -(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))
    return long.groupBy(*by, "label").agg(F.count("*").alias("n"), F.avg(lost).alias("loss"))


Scorer = Callable[[DataFrame, list[str]], float]


def mean_entropy(scored: DataFrame, labels: list[str]) -> float:
    """The scorer of a search: the mean of the labels' losses; smaller is better."""
    return cross_entropy(scored, labels).agg(F.avg("loss")).first()[0]


def searched(rows: DataFrame, group: str, vector: str, labels: list[str], kind: str, grid: list[dict], folds: int = 3, scorer: Scorer = mean_entropy) -> list[tuple[dict, float]]:
    """(choice, mean score) by grouped folds, best first; ties to the earlier choice.

    A choice has ``dims`` and any parameters of the model. The fits themselves are Spark jobs over all rows of their folds.
    """
    marked = rows.withColumn("_fold", fold(group, folds)).cache()
    out = []
    for choice in grid:
        params = {k: v for k, v in choice.items() if k != "dims"}
        scores = []
        for f in range(folds):
            model = fit(marked.where(F.col("_fold") != f), vector, labels, kind, choice["dims"], params)
            scores.append(scorer(model.scores(marked.where(F.col("_fold") == f), vector), labels))
        out.append((choice, sum(scores) / len(scores)))
    marked.unpersist()
    return sorted(out, key=lambda x: x[1])


def sampled_search(rows: DataFrame, group: str, vector: str, labels: list[str], kind: str, space: Space, trials: int, folds: int = 3, scorer: Scorer = mean_entropy, seed: int = 7) -> list[Trial]:
    """Trials of a sequential search by grouped folds, best first; ``space`` has ``dims`` and any parameters of the model.

    A trial's fit on a fold is a Spark job over all rows of the others.
    """
    marked = rows.withColumn("_fold", fold(group, folds)).cache()

    def loss(choice: dict, f: int) -> float:
        params = {k: v for k, v in choice.items() if k != "dims"}
        model = fit(marked.where(F.col("_fold") != f), vector, labels, kind, choice["dims"], params)
        return scorer(model.scores(marked.where(F.col("_fold") == f), vector), labels)

    out = sampled(space, loss, folds, trials, seed)
    marked.unpersist()
    return out


def cross_validated(rows: DataFrame, group: str, vector: str, labels: list[str], kind: str, dims: list[int], folds: int = 3) -> list[tuple[int, float]]:
    """(dimensions, mean loss) by grouped folds, best first; ties to fewer dimensions."""
    return [(c["dims"], loss) for c, loss in searched(rows, group, vector, labels, kind, [{"dims": d} for d in sorted(dims)], folds)]


def per_document(scored: DataFrame, group: str, labels: list[str], cut: float = 0.5) -> DataFrame:
    """A document's mean score of its segments, and the prediction."""
    means = scored.groupBy(group).agg(*(F.max(y).alias(y) for y in labels), *(F.avg(f"score_{y}").alias(f"score_{y}") for y in labels))
    return means.withColumns({f"pred_{y}": (F.col(f"score_{y}") >= cut).cast("int") for y in labels})


def importance(fitted: Fitted) -> dict[str, list[float]]:
    """Weight of each component per label: a tree model's own importance, else the coefficient's size times the component's spread."""
    spread = [v**0.5 for v in fitted.reduction.stages[0].explainedVariance.toArray()]
    out = {}
    for label, m in fitted.models.items():
        if isinstance(m, float):
            out[label] = [0.0] * len(spread)
        elif isinstance(m, KernelModel):
            raise ValueError("a kernel machine has no weights of components: use permutation_importance")
        elif hasattr(m, "featureImportances"):
            out[label] = list(m.featureImportances.toArray())
        else:
            out[label] = [abs(c) * s for c, s in zip(m.coefficients.toArray(), spread, strict=True)]
    return out


def permutation_importance(fitted: Fitted, rows: DataFrame, vector: str, labels: list[str], key: str, seed: int = 99, bucket: int = 10_000) -> DataFrame:
    """(component, label, importance): how much the loss grows when a component's values change places among the rows.

    For a model without weights of its own. Rows change places inside buckets of about ``bucket`` rows by a hash of
    ``key``, so no sort passes through one task; all components are scored in one job.
    """
    names = [f"_{y}" for y in labels]
    reduced = fitted.reduced(rows, vector).select(F.col(key).alias("_k"), *(F.col(y).alias(n) for y, n in zip(labels, names, strict=True)), vector_to_array("x").alias("_x"))
    buckets = max(1, -(-rows.count() // bucket))
    home = reduced.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(buckets)))
    home = home.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_k"))).withColumn("component", F.explode(F.sequence(F.lit(0), F.size("_x") - 1)))
    drawn = Window.partitionBy("_b", "component").orderBy(F.xxhash64(F.lit(seed), "component", "_k"))
    donors = home.select("_b", "component", F.row_number().over(drawn).alias("_n"), F.get("_x", F.col("component")).alias("_v"))
    moved = F.transform("_x", lambda v, k: F.when(k == F.col("component"), F.col("_v")).otherwise(v))
    own = [F.col(n).alias(y) for y, n in zip(labels, names, strict=True)]
    mixed = home.join(donors, ["_b", "component", "_n"]).select("component", *own, array_to_vector(moved).alias("x"))
    before = cross_entropy(fitted.scored(reduced.select(*own, array_to_vector("_x").alias("x"))), labels).select("label", F.col("loss").alias("_before"))
    after = cross_entropy(fitted.scored(mixed), labels, by=("component",))
    return after.join(before, "label").select("component", "label", (F.col("loss") - F.col("_before")).alias("importance"))


def save(fitted: Fitted, path: str) -> None:
    """The reduction and all models below a folder; a kernel machine and ``newton`` trees can't be stored."""
    if any(isinstance(m, KernelModel) for m in fitted.models.values()):
        raise ValueError("a kernel machine can't be stored")
    if any(isinstance(m, BoostedModel) for m in fitted.models.values()):
        raise ValueError("newton trees can't be stored")
    fitted.reduction.write().overwrite().save(f"{path}/reduction")
    spark = SparkSession.getActiveSession()
    rows = [(y, float(m) if isinstance(m, float) else None, "" if isinstance(m, float) else f"{type(m).__module__}.{type(m).__name__}") for y, m in fitted.models.items()]
    spark.createDataFrame(rows, "label string, constant double, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")
    for y, m in fitted.models.items():
        if not isinstance(m, float):
            m.write().overwrite().save(f"{path}/model_{y}")


def load(path: str) -> Fitted:
    """What ``save`` wrote."""
    spark = SparkSession.getActiveSession()
    kinds = {c.__name__: c for c in (GBTClassificationModel, LinearSVCModel, LogisticRegressionModel, RandomForestClassificationModel)}
    rows = spark.read.schema("label string, constant double, kind string").json(f"{path}/labels").collect()  # one row a label
    models = {r["label"]: r["constant"] if not r["kind"] else kinds[r["kind"].rpartition(".")[2]].load(f"{path}/model_{r['label']}") for r in rows}
    return Fitted(PipelineModel.load(f"{path}/reduction"), models)

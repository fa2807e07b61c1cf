"""One model for all accounts: recipe, four algorithms, tuning, test scores and importance."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from diarist.operators.evaluate import (
    auc_ci, auc_of_counts, collect_metrics, metrics_long, roc_curve, score_counts, select_best,
)
from diarist.operators.features import NOMINAL, NUMERIC, dummies
from diarist.operators.filters import impute_zero
from diarist.operators.resample import downsample, downsample_parts, draw_ranks, kfold, train_test_split
from diarist.plans.clean import cohort
from diarist.plans.grid import SIZES, param_grid
from diarist.schema import KEY, MODELS, ORDINAL, OUTCOME
from diarist.scratch import materialize, remove, scratch_path

# A threshold of 0.5 on the vote decides the class; every fit is seeded by this.
SEED = 555


@dataclass(frozen=True)
class Design:
    """Which columns are predictors, and which numeric ones are scaled."""

    nominal: Sequence[str] = tuple(NOMINAL)
    numeric: Sequence[str] = tuple(NUMERIC)
    unscaled: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        """Feature names in vector order."""
        return [*self.numeric, *self.unscaled, *dummies(self.nominal)]


def encode(df: DataFrame, design: Design) -> DataFrame:
    """Ordinal, account, outcome, label and one numeric column per feature; no statistics yet."""
    df = impute_zero(df)
    plain = [F.col(c).cast("double").alias(c) for c in (*design.numeric, *design.unscaled)]
    return df.select(
        ORDINAL, KEY, OUTCOME, (F.col(OUTCOME) == "true").cast("int").alias("label"),
        *plain, *[c.alias(n) for n, c in dummies(design.nominal).items()],
    )


def recipe(design: Design) -> list:
    """Pipeline stages: scale the numeric columns on the training rows, assemble all features."""
    rest = [n for n in design.names if n not in design.numeric]
    return [
        VectorAssembler(inputCols=list(design.numeric), outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *rest], outputCol="features"),
    ]


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the Gaussian kernel exp(-sigma * |x - y|^2), in Arrow batches."""

    sigma = Param(Params._dummy(), "sigma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="lifted", sigma=0.01, size=256, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="lifted", sigma=0.01, size=256, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sigma, size = self.getOrDefault(self.sigma), self.getOrDefault(self.size)
        seed = self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def lift(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy())
            rng = np.random.default_rng(seed)
            omega = rng.normal(0, np.sqrt(2 * sigma), (x.shape[1], size))
            phase = rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(x @ omega + phase)))

        lifted = array_to_vector(lift(vector_to_array(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), lifted)


def estimator(model: str, params: dict, rows: int, max_depth: int = 30, max_iter: int = 100) -> list:
    """Pipeline stages of one algorithm. The SVM cost and the loss reduction are sums over the
    training rows; Spark takes them per row, hence ``rows``.

    A forest's ``min_n`` bounds each child here; ``max_depth`` is Spark's own limit. Boosting is
    first-order. The SVM works on random Fourier features, with Platt scaling on its margin.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    if model == "rf":
        return [RandomForestClassifier(
            **common, numTrees=int(params["trees"]), featureSubsetStrategy=str(int(params["mtry"])),
            minInstancesPerNode=int(params["min_n"]), maxDepth=max_depth, seed=SEED,
        )]
    if model == "elnet":
        return [LogisticRegression(
            **common, regParam=params["penalty"], elasticNetParam=params["mixture"], maxIter=max_iter,
        )]
    if model == "xgb":
        return [GBTClassifier(
            **common, maxIter=int(params["trees"]), maxDepth=int(params["tree_depth"]),
            minInstancesPerNode=int(params["min_n"]), minInfoGain=params["loss_reduction"] / rows,
            subsamplingRate=params["sample_size"], featureSubsetStrategy=str(int(params["mtry"])),
            stepSize=params["learn_rate"], seed=SEED,
        )]
    return [
        FourierFeatures(sigma=float(params["rbf_sigma"])),
        LinearSVC(
            featuresCol="lifted", labelCol="label", rawPredictionCol="margin", predictionCol="_side",
            regParam=1 / (params["cost"] * rows), maxIter=max_iter,
        ),
        LogisticRegression(featuresCol="margin", labelCol="label", regParam=1e-6),
    ]


@dataclass
class Part:
    """What one fit learns from: the recipe, fitted on all training rows, and the resampled rows after it."""

    recipe: PipelineModel
    rows: DataFrame  # label, features
    path: str | None = None  # where the resampled rows are written, if they are

    @cached_property
    def n(self) -> int:
        return self.rows.count()


def part(train: DataFrame, design: Design, resample: Callable = downsample, written: bool = True) -> Part:
    """Fit the recipe on the training rows as they are, then resample them and apply it.

    Several fits on one part read labels and features from a written table; a single fit needs none.
    """
    fitted = Pipeline(stages=recipe(design)).fit(train)
    rows = fitted.transform(resample(train)).select("label", "features")
    if not written:
        return Part(fitted, rows)
    path = scratch_path(train.sparkSession, "resampled")
    rows.write.parquet(path)
    return Part(fitted, train.sparkSession.read.parquet(path), path)


def recipe_statistics(rows: DataFrame, design: Design, folds: int) -> DataFrame:
    """(fold, variable, mean, sd) that the scaler of each fold's fit holds; fold -1 is the final fit.

    One pass sums each fold; a fit's statistics are those of all folds but its own. Sums of squares of
    whole numbers are exact, as long as they stay below 2 ** 53.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("x")) for c in design.numeric])).alias("c")
    sums = rows.filter("split = 'training'").select("fold", cells).groupBy("fold", "c.variable").agg(
        F.count("c.x").alias("n"), F.sum("c.x").alias("s"), F.sum(F.col("c.x") * F.col("c.x")).alias("q")
    )  # a row for each fold and variable
    held = F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))).alias("held")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.select("*", held).filter("fold != held").groupBy(F.col("held").alias("fold"), "variable").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    ).select("fold", "variable", F.try_divide(s, n).alias("mean"), F.sqrt(F.try_divide(q - s * s / n, n - 1)).alias("sd"))


def fit(model: str, params: dict, part: Part, max_depth: int = 30, max_iter: int = 100) -> PipelineModel:
    """Fit one algorithm on a part; the result starts with the part's recipe."""
    rows = part.n if model in ("svm", "xgb") else 0
    stages = estimator(model, params, rows, max_depth, max_iter)
    fitted = Pipeline(stages=stages).fit(part.rows)
    return PipelineModel(part.recipe.stages + fitted.stages)


def score(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """(row_id, account_id, label, score) with the probability of a lapse."""
    return fitted.transform(rows).select(
        F.col(ORDINAL).alias("row_id"), KEY, "label", vector_to_array("probability")[1].alias("score")
    )


def run_jobs(jobs: Sequence, work: Callable, parallelism: int) -> list:
    """Run jobs at the same time; each is itself a distributed Spark job."""
    with ThreadPool(min(parallelism, max(len(jobs), 1))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(work), jobs)


@dataclass
class Options:
    """Cost of an analysis; the defaults are the study's."""

    folds: int = 10
    sizes: dict = field(default_factory=lambda: dict(SIZES))
    trees: int | None = None
    max_depth: int = 30
    max_iter: int = 100
    parallelism: int = 8
    models: Sequence[str] = tuple(MODELS)


def prepare(
    sample: DataFrame, design: Design, prop: float = 0.8, folds: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Encoded rows with ``split``, and ``fold`` on the training rows; written once.

    ``keys`` splits inside groups, such as an account's outcomes.
    """
    split = train_test_split(encode(sample, design), prop, keys)
    split = materialize(split, "split")
    train = kfold(split.filter("split = 'training'"), folds, [k for k in keys if k == KEY])
    test = split.filter("split = 'testing'").withColumn("fold", F.lit(None).cast("int"))
    # Folds of the pooled analysis are read one at a time, so they are folders of their own.
    return materialize(train.unionByName(test), "prepared", () if keys else ("split", "fold"))


@dataclass
class Resampled:
    """Training rows, and what the fits on them see: all but one fold each, and the whole."""

    rows: DataFrame
    without_fold: list
    whole: Part

    def close(self) -> None:
        """Delete the written parts."""
        remove(self.rows.sparkSession, *[p.path for p in (*self.without_fold, self.whole) if p.path])


def resampled(train: DataFrame, folds: int, design: Design, resample: Callable = downsample) -> Resampled:
    """Recipe and resampling inside each fold and over all training rows, once for all algorithms.

    Rows are cut to equal classes for all parts at once: ranked in one pass and written with the numbers of their parts.
    """
    subsets = [train.filter(F.col("fold") != f) for f in range(folds)] + [train]
    draws, path = [resample] * len(subsets), None
    if resample is downsample:
        path = scratch_path(train.sparkSession, "drawn")
        downsample_parts(train, folds).write.parquet(path)
        drawn = train.sparkSession.read.parquet(path)
        draws = [lambda _, f=f: drawn.filter(F.array_contains("parts", f)).drop("parts") for f in range(len(subsets))]
    *parts, whole = run_jobs([*zip(subsets, draws)], lambda job: part(job[0], design, job[1]), len(subsets))
    if path:
        remove(train.sparkSession, path)
    return Resampled(train, parts, whole)


def tune(train: Resampled, model: str, grid: Sequence[dict], options: Options) -> DataFrame:
    """Score every fold with every parameter set: (model, param_id, fold, row_id, label, score).

    Each fit writes its predictions; they are read back as one table, so no plan grows.
    """
    spark = train.rows.sparkSession
    path = scratch_path(spark, f"tune-{model}")

    def work(job):
        fold, params = job
        fitted = fit(model, params, train.without_fold[fold], options.max_depth, options.max_iter)
        out = score(fitted, train.rows.filter(F.col("fold") == fold))
        out.write.parquet(f"{path}/param_id={params['param_id']}/fold={fold}")

    run_jobs([(f, p) for p in grid for f in range(options.folds)], work, options.parallelism)
    return spark.read.parquet(path).withColumn("model", F.lit(model))


def best_params(predictions: DataFrame, grid: Sequence[dict]) -> tuple[dict, DataFrame]:
    """The set with the highest mean AUC, and the mean metrics of all sets."""
    folds = metrics_long(predictions, ["model", "param_id", "fold"])
    collected = materialize(collect_metrics(folds), "collected")
    chosen = select_best(collected).first()["param_id"]
    return next(p for p in grid if p["param_id"] == chosen), collected


def tuned(train: Resampled, model: str, design: Design, options: Options):
    """Tune one algorithm and fit it on all training rows: (fitted, parameters, mean metrics)."""
    grid = param_grid(model, len(design.names), options.sizes.get(model), SEED, options.trees)
    params, collected = best_params(tune(train, model, grid, options), grid)
    return fit(model, params, train.whole, options.max_depth, options.max_iter), params, collected


@dataclass
class PooledResult:
    """What one pooled analysis leaves behind."""

    predictions: DataFrame  # model, row_id, account_id, label, score on the test rows
    tuning: DataFrame  # model, param_id, metric, mean, n, std_err
    params: DataFrame  # model, name, value of the chosen set
    models: dict  # model -> fitted pipeline
    train: DataFrame
    test: DataFrame
    design: Design

    def metrics(self) -> DataFrame:
        return metrics_long(self.predictions, ["model"])

    def auc(self) -> DataFrame:
        return auc_ci(self.predictions, ["model"])

    def curves(self) -> DataFrame:
        return roc_curve(self.predictions, ["model"])

    def save(self, path: str) -> None:
        """Fitted pipelines and chosen parameters, for a later session."""
        for model, fitted in self.models.items():
            fitted.write().overwrite().save(f"{path}/{model}")
        self.params.write.mode("overwrite").parquet(f"{path}/params")


def pooled_models(sample: DataFrame, design: Design = Design(), options: Options | None = None) -> PooledResult:
    """Split, tune and fit every algorithm on the pooled entries, and score the test rows."""
    options = options or Options()
    rows = prepare(sample, design, folds=options.folds)
    test = rows.filter("split = 'testing'")
    train = resampled(rows.filter("split = 'training'"), options.folds, design)
    spark = sample.sparkSession
    path, models, chosen, tables = scratch_path(spark, "test-scores"), {}, [], []
    for model in options.models:
        models[model], params, collected = tuned(train, model, design, options)
        score(models[model], test).write.parquet(f"{path}/model={model}")
        chosen += [(model, name, float(value)) for name, value in params.items()]
        tables.append(collected)
    train.close()
    tuning = tables[0]
    for t in tables[1:]:
        tuning = tuning.unionByName(t)
    return PooledResult(
        spark.read.parquet(path), tuning,
        spark.createDataFrame(chosen, "model string, name string, value double"), models, train.rows, test, design,
    )


def model_importance(fitted: PipelineModel, model: str, design: Design) -> DataFrame:
    """Built-in importance: |coefficient| of the elastic net, gain of the tree models."""
    last = fitted.stages[-1]
    vector = last.coefficients if model == "elnet" else last.featureImportances
    rows = [(model, n, abs(float(v))) for n, v in zip(design.names, vector.toArray())]
    return SparkSession.getActiveSession().createDataFrame(
        rows, "model string, variable string, importance double"
    )


def permutation_importance(
    fitted: PipelineModel, model: str, train: DataFrame, design: Design, seed=SEED
) -> DataFrame:
    """AUC lost on the training rows when one feature is taken from another row, for every feature.

    Rows are ranked in hash order over the whole table, by running totals that gather nothing, and
    each takes the feature from the row that is next in rank (the last one from the first): a random
    permutation that keeps the rest of the row. One donor serves all features. A row whose donor has the
    same value keeps its score; the others are scored again, and the counts of all scores are written once.
    """
    spark = train.sparkSession
    prepared = PipelineModel(fitted.stages[:3])
    algorithm = PipelineModel(fitted.stages[3:])
    probability = vector_to_array("probability")[1]
    whole = algorithm.transform(prepared.transform(train)).select(
        ORDINAL, "label", vector_to_array("features").alias("x"), probability.alias("score")
    )
    paths = [scratch_path(spark, name) for name in ("permutation", "permutation-donors", "permutation-counts")]

    def written(df, path):
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ranked = written(draw_ranks(whole, (), f"{seed}:permute").drop(ORDINAL), paths[0])
    donors = ranked.select((F.col("draw_rank") - 2).alias("_next"), F.col("x").alias("y"), "draw_n").select(
        (F.pmod("_next", "draw_n") + 1).alias("draw_rank"), "y"
    )
    ready = written(ranked.join(donors, "draw_rank").select("label", "score", "x", "y"), paths[1])
    # Feature -1 leaves the row as it is.
    j, size = F.col("j"), len(design.names)
    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    same = F.filter(numbers, lambda i: F.get("x", i) == F.get("y", i))
    left = ready.select("label", F.explode(F.concat(F.array(F.lit(-1)), same)).alias("j"), "score")
    other = F.filter(numbers, lambda i: F.get("x", i) != F.get("y", i))
    swapped = F.concat(F.slice("x", F.lit(1), j), F.array(F.get("y", j)), F.slice("x", j + 2, F.lit(size)))
    trial = ready.select("label", "x", "y", F.explode(other).alias("j")).select(
        "label", "j", array_to_vector(swapped).alias("features")
    )
    scored = algorithm.transform(trial).select("label", "j", probability.alias("score"))
    counts = written(score_counts(left.unionByName(scored), ["j"]), paths[2])
    auc = materialize(auc_of_counts(counts, ["j"]).select("j", "auc"), "permuted")
    remove(spark, *paths)
    base = auc.filter("j = -1").select("auc").scalar()
    names = F.array(*[F.lit(n) for n in design.names])
    return auc.filter("j >= 0").select(
        F.lit(model).alias("model"), F.get(names, F.col("j")).alias("variable"),
        (base - F.col("auc")).alias("importance"),
    )


# Parameters of the four analyses: a smaller predictor set, fewer accounts, more accounts.
VARIANTS = {
    "main": {},
    "without_prior_lapse": {
        "design": Design(
            nominal=tuple(c for c in NOMINAL if c != "prior_event_lapse"),
            numeric=tuple(c for c in NUMERIC if c != "mins_since_prev_rep"),
            unscaled=("mins_since_prev_rep",),
        )
    },
    "without_no_lapses": {"outcomes": "any_lapse"},
    "min_10_entries": {"at_least": 10},
}


def variant_cohort(clean: DataFrame, name: str) -> tuple[DataFrame, Design]:
    config = VARIANTS[name]
    sample = cohort(clean, config.get("at_least", 20), config.get("outcomes", "all"))
    return sample, config.get("design", Design())


def analysis_variants(clean: DataFrame, options: Options | None = None, names=tuple(VARIANTS)) -> DataFrame:
    """Curves of every variant, written with an ``analysis`` column and read back as one table."""
    spark = clean.sparkSession
    path = scratch_path(spark, "variants")
    for name in names:
        result = pooled_models(*variant_cohort(clean, name), options)
        result.curves().write.parquet(f"{path}/analysis={name}")
    return spark.read.parquet(path)

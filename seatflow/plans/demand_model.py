"""Boosted-tree demand model on lag features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.functions.metrics import chance_ratio
from seatflow.operators.boosting import BinnedGBTRegressor
from seatflow.operators.features import LAGS, lag_features, prediction_frame, time_split
from seatflow.operators.summaries import mae_by, regression_metrics
from seatflow.session import use_checkpoints
from seatflow.sources.tables import stored

NUMERIC = (*LAGS, "rate_3yr_mean", "lag1_vacancy")
COMPETITIVE_PHASES = ("2B", "2C", "2C(S)")
SCHOOL_KEYS = ("school_name", "phase")
SCHOOL_CATEGORICAL = ("phase", "zone_code", "nature_code")
SCHOOL_FLAGS = ("sap_ind", "autonomous_ind", "gifted_ind")
SCHOOL_NUMERIC = (*NUMERIC, "registration_year", *SCHOOL_FLAGS)
TARGET = "subscription_rate"
#: Training rows of a task: about this many at most, and at least where there are cores to spare.
TASK_ROWS, LEAST_ROWS = 3_000_000, 20_000


@dataclass(frozen=True)
class Params:
    """Training settings of the production model."""

    trees: int = 300
    depth: int = 5
    rate: float = 0.05
    sampling: float = 0.8
    columns: float = 0.8
    min_leaf: int = 5
    seed: int = 42


def historical_rows(mart: DataFrame, dim: DataFrame) -> DataFrame:
    """Completed years of the competitive phases with the school attributes of today."""
    rows = mart.filter(
        F.col("phase_normalised").isin(*COMPETITIVE_PHASES) & ~F.col("is_current_year")
    ).select(
        "school_key",
        F.col("school_name_clean").alias("school_name"),
        F.col("phase_normalised").alias("phase"),
        "registration_year",
        TARGET,
        "vacancy",
    )
    attributes = dim.select("school_key", "zone_code", "nature_code", *SCHOOL_FLAGS)
    return rows.join(attributes, "school_key").drop("school_key")


def _with_gaps_marked(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Trees here need numbers: a NULL becomes -1 and a flag column says so."""
    return df.withColumns(
        {f"{c}_known": F.col(c).isNotNull().cast("double") for c in numeric}
        | {f"{c}_value": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numeric}
    )


def _n_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass over the training rows."""
    return max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // TASK_ROWS))


def train(
    df: DataFrame,
    target: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    params: Params = Params(),
) -> PipelineModel:
    """Fit on all rows; training is distributed over the rows and checkpoints its lineage, that of
    the features included.

    A tree takes a job over all rows for each of its levels, so these have as many tasks as there
    are cores, fewer where a task would get next to no rows, and more where it would get too many.
    """
    use_checkpoints(df.sparkSession)
    marked = _with_gaps_marked(df, numeric)
    indexed = [f"{c}_index" for c in categorical]
    stages = [
        StringIndexer(
            inputCols=list(categorical), outputCols=indexed, handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        VectorAssembler(
            inputCols=[*indexed, *[f"{c}_{s}" for c in numeric for s in ("value", "known")]],
            outputCol="features",
        ),
        BinnedGBTRegressor(
            featuresCol="features", labelCol=target, predictionCol="predicted",
            maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate,
            subsamplingRate=params.sampling, featureSubsetStrategy=str(params.columns),
            minInstancesPerNode=params.min_leaf,
            # The node of each row is found by walking down these flat trees.
            seed=params.seed, checkpointInterval=10, cacheNodeIds=False,
        ),
    ]
    rows = marked.filter(F.col(target).isNotNull())
    rows = rows.repartition(_n_tasks(rows.count(), df.sparkSession.sparkContext.defaultParallelism))
    indexer = stages[0].fit(rows)
    # A categorical feature needs a bin per value, and one for values not seen in training.
    stages[-1].setMaxBins(max([64, *(len(labels) + 1 for labels in indexer.labelsArray)]))
    # The tasks of every job carry the plan of their rows, so the features are written first.
    ready = PipelineModel([indexer, stages[1]]).transform(rows).select("features", target).checkpoint()
    return PipelineModel([indexer, stages[1], *Pipeline(stages=stages[2:]).fit(ready).stages])


def predict(model: PipelineModel, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return model.transform(_with_gaps_marked(df, numeric))


def score(model: PipelineModel, frame: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Predicted rate, never below zero, and the chance (0 to 1) that follows from it."""
    rate = F.greatest(F.col("predicted"), F.lit(0.0))
    return (
        predict(model, frame, numeric)
        .withColumn("predicted_subscription_rate", rate)
        .withColumn(
            "predicted_ballot_chance_pct", chance_ratio(F.col("predicted_subscription_rate"))
        )
    )


def prediction_table(scored: DataFrame, version: str) -> DataFrame:
    """Scored rows in the layout of the prediction table, with the run columns."""
    return scored.select(
        "school_name",
        "phase",
        F.col("registration_year").cast("int").alias("registration_year"),
        "predicted_subscription_rate",
        "predicted_ballot_chance_pct",
        F.lit(version).alias("model_version"),
        F.current_timestamp().alias("trained_at"),
    )


def train_and_predict(
    history: DataFrame,
    train_years: Sequence[int],
    eval_years: Sequence[int],
    predict_year: int,
    version: str,
    path: str,
    params: Params = Params(),
) -> tuple[DataFrame, DataFrame]:
    """(prediction table, run record) of one training on the school rows.

    Training reads its rows several times, so the history and its features are
    first written below ``path``.
    """
    year = "registration_year"
    history = stored(history, f"{path}/history")
    lagged = stored(
        lag_features(history, SCHOOL_KEYS, year, TARGET, "vacancy", SCHOOL_FLAGS),
        f"{path}/features",
    )
    split = time_split(lagged, year, TARGET, train_years, eval_years)
    model = train(
        split.filter("part = 'train'"), TARGET, SCHOOL_CATEGORICAL, SCHOOL_NUMERIC, params
    )
    held_out = predict(model, split.filter("part = 'eval'"), SCHOOL_NUMERIC)
    record = run_record(
        version, params, *evaluate(held_out, TARGET, "phase"), split, year, TARGET, model
    )
    frame = prediction_frame(
        history,
        SCHOOL_KEYS,
        year,
        predict_year,
        TARGET,
        "vacancy",
        ["zone_code", "nature_code", *SCHOOL_FLAGS],
        SCHOOL_FLAGS,
    )
    return prediction_table(score(model, frame, SCHOOL_NUMERIC), version), record


def save_model(model: PipelineModel, path: str, record: DataFrame | None = None) -> None:
    """The whole model with its indexers, and beside it the run record if one is given."""
    model.write().overwrite().save(f"{path}/model")
    if record is not None:
        log_run(record, f"{path}/runs")


def load_model(path: str) -> PipelineModel:
    """A model as it was saved, in this or another session."""
    return PipelineModel.load(f"{path}/model")


def baseline_errors(scored: DataFrame, target: str, last: str = LAGS[0]) -> DataFrame:
    """Mean absolute errors, over the held-out rows whose last year is known, of the model and of
    taking last year's rate for this year's: ``n_rows, model_mae, baseline_mae``."""
    known = scored.filter(F.col(last).isNotNull())
    off = lambda c: F.avg(F.abs(F.col(target) - F.col(c)))
    return known.agg(F.count("*").alias("n_rows"), off("predicted").alias("model_mae"), off(last).alias("baseline_mae"))


def importances(model: PipelineModel, spark: SparkSession, limit: int | None = 10) -> DataFrame:
    """Feature weights, heaviest first. Their number is the number of features."""
    names = model.stages[1].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    frame = frame.orderBy(F.col("importance").desc(), "feature")
    return frame if limit is None else frame.limit(limit)


def evaluate(scored: DataFrame, target: str, category: str) -> tuple[DataFrame, DataFrame]:
    """Overall errors, and the mean absolute error per category that has rows."""
    return (
        regression_metrics(scored, target, "predicted"),
        mae_by(scored, category, target, "predicted"),
    )


def run_record(
    run_name: str,
    params: Params,
    metrics: DataFrame,
    by_category: DataFrame,
    split: DataFrame,
    year: str,
    target: str,
    model: PipelineModel,
) -> DataFrame:
    """One row per run: settings, what it was trained and held out on, features and their
    weights, errors overall and per category."""
    settings = F.create_map(
        *[F.lit(x) for pair in asdict(params).items() for x in (pair[0], str(pair[1]))]
    )
    category = by_category.columns[0]
    # One entry per category of the model.
    entry = F.struct(F.concat(F.lit("mae_phase_"), F.regexp_replace(category, r"[()]", "")), "mae")
    per = by_category.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))))
    names = model.stages[1].getInputCols()
    weights = dict(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=True))
    of_part = lambda part, c: c(F.when(F.col("part") == part, F.col(year)))
    data = split.agg(
        *[
            of_part(part, fn).alias(f"{part}_{what}")
            for part in ("train", "eval")
            for what, fn in (("rows", F.count), ("first_year", F.min), ("last_year", F.max))
        ]
    )
    figures = data.select(F.struct("*")).scalar()
    return metrics.withColumn("data", figures).select(
        F.lit(run_name).alias("run_name"),
        settings.alias("params"),
        F.lit(target).alias("target"),
        F.array(*map(F.lit, names)).alias("features"),
        F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]).alias("importances"),
        *metrics.columns,
        "data.*",
        per.scalar().alias("mae_by_category"),
        F.current_timestamp().alias("logged_at"),
    )


def log_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)

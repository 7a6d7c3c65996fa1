"""Lag features, split, demand model and prediction rows."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatflow.catalog import schools
from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import (
    CURRENT,
    PIPELINE_CURRENT,
    RATED,
    SPARSE,
    WITH_MART,
    rated,
    sparse_cells,
)
from seatflow.functions.cleaning import round_to
from seatflow.operators import features
from seatflow.plans import demand_model as D
from seatflow.session import fresh_path
from seatflow.sources.tables import overwrite_table, stored

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql

KEYS = ["entity", "category"]
CATEGORICAL = ["category", "zone"]
NUMERIC = [*D.NUMERIC, "year", "flag"]

MEAN = """CASE WHEN lag1 IS NULL AND lag2 IS NULL AND lag3 IS NULL THEN NULL ELSE
    CAST(round(CAST((coalesce(lag1, 0) + coalesce(lag2, 0) + coalesce(lag3, 0))
      / ((lag1 IS NOT NULL)::INT + (lag2 IS NOT NULL)::INT + (lag3 IS NOT NULL)::INT)
      AS DECIMAL(38, 12)), 6) AS DOUBLE) END"""


def _features(spark, sf):
    return features.lag_features(sparse_cells(spark, sf), KEYS, "year", "rate", "vacancy", ["flag"])


@query(
    "lag_features",
    f"""WITH {SPARSE}, lagged AS (SELECT a.*, b.rate AS lag1, c.rate AS lag2, d.rate AS lag3,
        b.vacancy AS lag1_vacancy FROM sparse a
      LEFT JOIN sparse b ON a.entity = b.entity AND a.category = b.category AND b.year = a.year - 1
      LEFT JOIN sparse c ON a.entity = c.entity AND a.category = c.category AND c.year = a.year - 2
      LEFT JOIN sparse d ON a.entity = d.entity AND a.category = d.category AND d.year = a.year - 3)
    SELECT entity, category, year, lag1, lag2, lag3, lag1_vacancy, {MEAN} AS rate_3yr_mean,
      CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM lagged""",
)
def lag_features(spark, sf):
    return _features(spark, sf).select(
        *KEYS, "year", *features.LAGS, "lag1_vacancy",
        round_to(F.col("rate_3yr_mean"), 6).alias("rate_3yr_mean"), "flag",
    )


@query(
    "time_split",
    f"""WITH {RATED} SELECT entity, category, year, rate,
      CASE WHEN year < 2000 THEN 'train' ELSE 'eval' END AS part
    FROM rated WHERE rate IS NOT NULL AND year BETWEEN 1996 AND 2000""",
)
def time_split(spark, sf):
    split = features.time_split(rated(spark, sf), "year", "rate", range(1996, 2000), [2000])
    return split.select(*KEYS, "year", "rate", "part")


def _frame(spark, sf):
    completed = sparse_cells(spark, sf).filter(F.col("year") < CURRENT)
    return features.prediction_frame(
        completed, KEYS, "year", CURRENT, "rate", "vacancy", ["zone", "flag"], ["flag"]
    )


@query(
    "prediction_frame",
    f"""WITH {SPARSE}, done AS (SELECT * FROM sparse WHERE year < {CURRENT}),
    lagged AS (SELECT entity, category, arg_max(zone, year) FILTER (WHERE zone IS NOT NULL) AS zone,
        arg_max(flag, year) AS flag, max(rate) FILTER (WHERE year = {CURRENT - 1}) AS lag1,
        max(rate) FILTER (WHERE year = {CURRENT - 2}) AS lag2,
        max(rate) FILTER (WHERE year = {CURRENT - 3}) AS lag3,
        max(vacancy) FILTER (WHERE year = {CURRENT - 1}) AS lag1_vacancy
      FROM done GROUP BY 1, 2)
    SELECT entity, category, CAST({CURRENT} AS BIGINT) AS year, zone,
      CASE WHEN flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag, lag1, lag2, lag3, lag1_vacancy,
      {MEAN} AS rate_3yr_mean
    FROM lagged WHERE lag1 IS NOT NULL OR lag2 IS NOT NULL OR lag3 IS NOT NULL""",
)
def prediction_frame(spark, sf):
    return _frame(spark, sf).withColumn("rate_3yr_mean", round_to(F.col("rate_3yr_mean"), 6))


PARAMS = D.Params()
FEATURES = [*[f"{c}_index" for c in CATEGORICAL], *[f"{c}_{s}" for c in NUMERIC for s in ("value", "known")]]
_TRAINED: dict[tuple[str, str], tuple] = {}


def _trained(spark, sf):
    """(model, split rows), trained once for a session and folder."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _TRAINED:
        rows = stored(_features(spark, sf), fresh_path(spark, "features"))
        split = features.time_split(rows, "year", "rate", range(1995, 2000), [2000])
        model = D.train(split.filter("part = 'train'"), "rate", CATEGORICAL, NUMERIC, PARAMS)
        _TRAINED[place] = model, split
    return _TRAINED[place]


def _soundness():
    """Rates are at least 0 and chances what the rates say."""
    rate, chance = F.col("predicted_subscription_rate"), F.col("predicted_ballot_chance_pct")
    said = F.when(rate <= 1, 1.0).otherwise(1 / rate)
    return (rate >= 0).alias("rate_ok"), (F.abs(chance - said) < 1e-12).alias("chance_ok")


@query(
    "gbt_predict",
    f"SELECT entity, category, year, true AS rate_ok, true AS chance_ok FROM ({SQL['prediction_frame']})",
)
def gbt_predict(spark, sf):
    """Predictions of the full model: one for each row to predict, each one sound."""
    model, _ = _trained(spark, sf)
    scored = D.score(model, _frame(spark, sf), NUMERIC)
    return scored.select(*KEYS, "year", *_soundness())


@query(
    "model_error",
    f"""WITH {SPARSE} SELECT count(*) AS n_rows,
      CAST(round(CAST(avg(abs(a.rate - b.rate)) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS baseline_mae,
      true AS below_baseline
    FROM sparse a JOIN sparse b ON a.entity = b.entity AND a.category = b.category AND b.year = a.year - 1
    WHERE a.year = 2000 AND a.rate IS NOT NULL AND b.rate IS NOT NULL""",
)
def model_error(spark, sf):
    """The held-out error of the model against that of last year's rate, which it has to beat."""
    model, split = _trained(spark, sf)
    held_out = D.predict(model, split.filter("part = 'eval'"), NUMERIC)
    return D.baseline_errors(held_out, "rate").select(
        "n_rows", round_to(F.col("baseline_mae"), 6).alias("baseline_mae"),
        (F.col("model_mae") < F.col("baseline_mae")).alias("below_baseline"),
    )


@query(
    "model_reload",
    f"SELECT entity, category, year, true AS same_rate, true AS same_chance FROM ({SQL['prediction_frame']})",
)
def model_reload(spark, sf):
    """Predictions of the model after it was saved and loaded, held against those before."""
    model, _ = _trained(spark, sf)
    path = fresh_path(spark, "model")
    D.save_model(model, path)
    frame = stored(_frame(spark, sf), fresh_path(spark, "frame"))
    names = ["predicted_subscription_rate", "predicted_ballot_chance_pct"]
    before = D.score(model, frame, NUMERIC).select(*KEYS, "year", *names)
    after = D.score(D.load_model(path), frame, NUMERIC).select(*KEYS, "year", *[F.col(c).alias(f"{c}_again") for c in names])
    same = [(F.col(c) == F.col(f"{c}_again")).alias(a) for c, a in zip(names, ("same_rate", "same_chance"), strict=True)]
    return before.join(after, [*KEYS, "year"]).select(*KEYS, "year", *same)


@query(
    "gbt_importances",
    f"""SELECT unnest({FEATURES}) AS feature, true AS is_share, true AS shares_sum_to_one""",
)
def gbt_importances(spark, sf):
    """A weight for every feature; together they are one."""
    model, _ = _trained(spark, sf)
    weights = D.importances(model, spark, limit=None)
    total = F.sum("importance").over(W.partitionBy())
    return weights.select(
        "feature", F.col("importance").between(0, 1).alias("is_share"),
        (F.abs(total - 1) < 1e-9).alias("shares_sum_to_one"),
    )


@query(
    "run_log",
    f"""WITH {SPARSE}, part AS (SELECT category, year, CASE WHEN year < 2000 THEN 'train' ELSE 'eval' END AS part
      FROM sparse WHERE rate IS NOT NULL AND year BETWEEN 1995 AND 2000)
    SELECT 'trees' AS run_name, '300' AS trees, '42' AS seed, 'rate' AS target, {len(FEATURES)} AS n_features,
      {len(FEATURES)} AS n_importances, true AS errors_known,
      count(*) FILTER (WHERE part = 'train') AS train_rows, min(year) FILTER (WHERE part = 'train') AS train_first_year,
      max(year) FILTER (WHERE part = 'train') AS train_last_year, count(*) FILTER (WHERE part = 'eval') AS eval_rows,
      min(year) FILTER (WHERE part = 'eval') AS eval_first_year, max(year) FILTER (WHERE part = 'eval') AS eval_last_year,
      list_sort(list_transform(list_distinct(list(category) FILTER (WHERE part = 'eval')),
        lambda c: 'mae_phase_' || c)) AS by_category
    FROM part""",
)
def run_log(spark, sf):
    """What a run leaves behind, read back."""
    model, split = _trained(spark, sf)
    held_out = D.predict(model, split.filter("part = 'eval'"), NUMERIC)
    overall, by_category = D.evaluate(held_out, "rate", "category")
    path = fresh_path(spark, "runs")
    D.log_run(D.run_record("trees", PARAMS, overall, by_category, split, "year", "rate", model), path)
    known = [F.col(c).isNotNull() for c in overall.columns]
    return spark.read.parquet(path).select(
        "run_name", F.col("params.trees").alias("trees"), F.col("params.seed").alias("seed"), "target",
        F.size("features").alias("n_features"), F.size("importances").alias("n_importances"),
        reduce(lambda a, b: a & b, known).alias("errors_known"),
        *[f"{p}_{c}" for p in ("train", "eval") for c in ("rows", "first_year", "last_year")],
        F.array_sort(F.map_keys("mae_by_category")).alias("by_category"),
    )


@query(
    "historical_rows",
    WITH_MART
    + """SELECT m.school_name_clean AS school_name, m.phase_normalised AS phase, m.registration_year,
      m.subscription_rate, m.vacancy, d.zone_code, d.nature_code, d.sap_ind, d.autonomous_ind, d.gifted_ind
    FROM mart m JOIN dim d USING (school_key)
    WHERE m.phase_normalised IN ('2B', '2C', '2C(S)') AND NOT m.is_current_year""",
)
def historical_rows(spark, sf):
    return D.historical_rows(schools.mart(spark, sf), schools.dim(spark, sf))


_PREDICTED: dict[tuple[str, str], str] = {}


def _predicted(spark, sf):
    """Where the prediction table of a training on the school rows is, made once for a session and folder."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _PREDICTED:
        tables = schools.tables(spark, sf)
        table, _ = D.train_and_predict(
            D.historical_rows(tables["mart_school_analysis"], tables["dim_school"]),
            train_years=range(2019, 2022),
            eval_years=[2022],
            predict_year=PIPELINE_CURRENT,
            version="trees-1",
            path=fresh_path(spark, "training"),
            params=PARAMS,
        )
        out = fresh_path(spark, "predictions")
        overwrite_table(table, out)
        _PREDICTED[place] = out
    return _PREDICTED[place]


@query(
    "school_predictions",
    f"""WITH h AS ({SQL["historical_rows"]})
    SELECT school_name, phase, {PIPELINE_CURRENT} AS registration_year, 'trees-1' AS model_version,
      true AS rate_ok, true AS chance_ok FROM h
    GROUP BY 1, 2 HAVING count(subscription_rate) FILTER (WHERE registration_year
      BETWEEN {PIPELINE_CURRENT} - 3 AND {PIPELINE_CURRENT} - 1) > 0""",
)
def school_predictions(spark, sf):
    """Training on the stored mart rows, and the prediction table it leaves behind."""
    return spark.read.parquet(_predicted(spark, sf)).select(
        "school_name", "phase", "registration_year", "model_version", *_soundness()
    )

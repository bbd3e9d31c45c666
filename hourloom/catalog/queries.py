"""Named queries. Each takes ``(spark, sf_dir)`` and reads the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..config import ExperimentSettings, ScaleSettings
from ..functions import risk, scalars
from ..models.bundle import Bundle, load_bundle, save_bundle, score_recent
from ..models.gram import fold_ridge, series_ridge as ridge_by_series, with_prediction
from ..models.trainers import fit, fit_until_patience, importances, tail_errors, top_importances
from ..operators import align, fences, summary, validate
from ..operators.features import all_features, build_features, complete_rows
from ..operators.fill import fill_series
from ..operators.order_stats import quantiles
from ..operators.rolling import trailing_stats
from ..operators.scale import along_series, ensure_checkpoint_dir, row_positions, settle
from ..plans.clean import clean_and_bound, clean_panel, clean_series
from ..plans.ingest import run_ingest
from ..plans.experiment import fold_models, fold_predictions, model_scores, run_experiment
from ..plans.monitor import latest_risk, recent_risk
from ..plans.train_only import clean_train_only as train_only_rows
from ..plans.train_only import fold_features, train_only_scores
from ..sources.payloads import rejected_stations, station_rows, weather_rows
from ..sources.tables import bounded_history, read_dated, write_dated, write_records
from ..streaming.hourly import (
    append_hours, append_missed, closed_hours, late_hours, missed_hours, newest_hours, record_hours,
    recorded_hours,
)
from ..streaming.refresh import current_features, refresh_features, repair_late

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["station"]
LATE = "2024-01-24 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


OFF_TIE = 3.3e-10


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that both engines show the same value.

    Means of cents over small counts often end exactly on a half; a shift far below the shown
    digits decides those the same way everywhere.
    """
    return df.select(*[
        F.round(F.col(f.name) + OFF_TIE, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema])


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/hourloom-{uuid4().hex}"


def clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_series(fx.readings(spark, d), fx.weather(spark, d), "station")


def _clean_and_bound(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Clean rows and a bound of the longest series' rows; cleaning adds no rows."""
    return clean_and_bound(fx.readings(spark, d), fx.weather(spark, d), "station")


def features(spark: SparkSession, d: str) -> DataFrame:
    rows, bound = _clean_and_bound(spark, d)
    return build_features(rows, KEY, rows_bound=bound)


def features_with_warm_up(spark: SparkSession, d: str) -> DataFrame:
    rows, bound = _clean_and_bound(spark, d)
    return all_features(rows, KEY, rows_bound=bound)


# ---- sources and sinks -------------------------------------------------------------------


@query
def station_feed_rows(spark, d):
    return station_rows(fx.station_payloads(spark, d)).select(
        "station", "timestamp", "pm25", "pm10", "no2", "o3", "aqi")


@query
def station_feed_rejects(spark, d):
    """Payloads without a row, by station and reason."""
    return rejected_stations(fx.station_payloads(spark, d))


@query
def weather_payload_rows(spark, d):
    return weather_rows(fx.weather_payloads(spark, d))


@query
def bounded_history_load(spark, d):
    raw = fx.events(spark, d).select("event_id", "ts", "value")
    return bounded_history(raw, date(2024, 1, 25), 10, ts="ts")


@query
def history_splice(spark, d):
    history = fx.readings(spark, d)
    live = history.where(F.col("timestamp") >= F.lit(LATE).cast("timestamp_ntz"))
    return tidy(align.splice_history(history, live.withColumn("pm10", F.col("pm25") * 2)))


@query
def history_splice_by_station(spark, d):
    """Stations whose live rows begin at different times."""
    history = fx.readings(spark, d)
    begun = F.lit(LATE).cast("timestamp_ntz") + F.expr("make_dt_interval(0, length(station))")
    live = history.where(F.col("timestamp") >= begun).withColumn("pm10", F.col("pm25") * 2)
    return tidy(align.splice_history(history, live, key="station"))


@query
def clean_with_live(spark, d):
    """Cleaning with the last live row of each station laid over its hour."""
    readings = fx.readings(spark, d)
    live = readings.select("station", "timestamp", (F.col("pm25") + 100).alias("pm25"),
                           F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("ordinal"))
    return tidy(clean_series(readings, fx.weather(spark, d), "station", live=live))


@query
def ingest_run(spark, d):
    """Landed station and weather texts and stored history to the dated clean table."""
    base = scratch(spark)
    late = F.lit(LATE).cast("timestamp_ntz")
    fx.station_payloads(spark, d).write.json(f"{base}/stations")
    fx.weather_payloads(spark, d).withColumn("station", F.lit("any")).write.json(f"{base}/weather")
    fx.readings(spark, d).where(F.col("timestamp") < late).write.parquet(f"{base}/history")
    return tidy(run_ingest(spark, f"{base}/stations", f"{base}/weather", f"{base}/history",
                           date(2024, 2, 7), 30, f"{base}/clean"))


@query
def dated_sink(spark, d):
    path, rows = scratch(spark), fx.readings(spark, d)
    write_dated(rows, path, date(2024, 1, 30))
    write_dated(rows, path, date(2024, 1, 31))
    write_dated(rows, path, date(2024, 1, 31))
    return tidy(read_dated(spark, path, date(2024, 1, 31)))


@query
def dated_csv_sink(spark, d):
    path, rows = scratch(spark), fx.weather(spark, d)
    write_dated(rows, path, date(2024, 1, 31), fmt="csv")
    return tidy(read_dated(spark, path, date(2024, 1, 31), rows.schema.simpleString()[7:-1]
                           .replace(":", " "), fmt="csv"))


@query
def result_records(spark, d):
    path = scratch(spark)
    scores = fold_scores(spark, d)
    write_records(scores, path)
    return spark.read.schema(scores.schema).json(path)


# ---- projections, filters, predicates ----------------------------------------------------


@query
def hour_floor(spark, d):
    return align.to_hour(fx.events(spark, d).select("event_id", "ts"), "ts")


@query
def column_projection(spark, d):
    return tidy(fx.readings(spark, d).select("timestamp", "pm25", "aqi", "no2", "o3"))


def _shifted(spark, d) -> DataFrame:
    """Raw values moved down so that some are negative, with some missing."""
    return fx.events(spark, d).select("event_id", F.when(
        F.col("user_id") % 13 != 0, F.col("value") - 20).alias("pm25"))


@query
def negative_clip(spark, d):
    return tidy(_shifted(spark, d).withColumn("pm25", scalars.clip_lower(F.col("pm25"), 0.0)))


@query
def fence_clip(spark, d):
    p = fx.panel(spark, d).select("station", "timestamp", "pm25", "no2", "o3")
    return tidy(fences.clip_to_fences(p, ("pm25", "no2", "o3"), KEY))


@query
def divisor_floor(spark, d):
    return tidy(fx.weather(spark, d).select("timestamp", scalars.clip_lower(
        F.col("wind_speed"), 0.1).alias("wind_speed")))


@query
def live_overlay(spark, d):
    live = fx.events(spark, d).select(
        F.col("event_type").alias("station"), scalars.floor_hour(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("pm25"), "event_id")
    p = fx.panel(spark, d).select("station", "timestamp", "pm25")
    return tidy(align.overlay_last(p, live, "event_id", "station"))


@query
def drop_missing_target(spark, d):
    p = fx.panel(spark, d).select("station", "timestamp", "pm25", "aqi")
    return tidy(complete_rows(p, ["pm25"]))


@query
def drop_incomplete_rows(spark, d):
    rows = fx.panel(spark, d).select("station", "timestamp", "pm25", "temp", "humidity", "no2")
    return tidy(complete_rows(rows, ["pm25", "temp", "humidity", "no2", "timestamp"]))


@query
def feature_presence(spark, d):
    """Each feature in model order with the number of rows that have it."""
    wide = features_with_warm_up(spark, d)
    names = [c for c in wide.columns if c not in ("station", "timestamp", "pm25")]
    counts = wide.agg(*[F.count(n).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"),
                               F.col(n).alias("present")) for i, n in enumerate(names)])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


@query
def clean_without_optional(spark, d):
    p = fx.panel(spark, d).select("station", "timestamp", "pm25", "temp", "wind_speed")
    return tidy(clean_panel(p, KEY))


# ---- joins -------------------------------------------------------------------------------


@query
def hour_join(spark, d):
    return tidy(fx.panel(spark, d))


@query
def risk_bands(spark, d):
    v = F.col("pm25")
    return tidy(_shifted(spark, d).select(
        "event_id", "pm25", risk.risk_band(v).alias("band"), risk.risk_label(v).alias("label"),
        risk.risk_color(v).alias("color"), risk.risk_action(v).alias("action")))


@query
def alert_rows(spark, d):
    """The alert table with the number of raw readings in each band."""
    per_band = _shifted(spark, d).groupBy(risk.risk_band(F.col("pm25")).alias("band")).agg(
        F.count(F.lit(1)).alias("readings"))
    return risk.alert_table(spark).join(per_band, "band", "left").select(
        "band", "label", "value_range", "audience", "action",
        F.coalesce("readings", F.lit(0)).alias("readings"))


# ---- aggregations ------------------------------------------------------------------------


@query
def quartile_fences(spark, d):
    p = fx.panel(spark, d)
    return tidy(fences.upper_fences(p, ("pm25", "no2", "o3"), KEY))


@query
def clipped_counts(spark, d):
    return fences.clipped_counts(fx.panel(spark, d), ("pm25", "no2", "o3"), KEY)


@query
def hour_profile(spark, d):
    return tidy(summary.hour_profile(clean(spark, d)))


@query
def station_hour_profile(spark, d):
    return tidy(summary.hour_profile(clean(spark, d), KEY))


@query
def raw_hour_profile(spark, d):
    return tidy(summary.hour_profile(fx.events(spark, d), ts="ts", value="value"))


@query
def trailing_statistics(spark, d):
    return tidy(summary.trailing_statistics(clean(spark, d), 720, KEY))


@query
def describe_clean(spark, d):
    return summary.describe(clean(spark, d), ["pm25", "temp", "humidity", "wind_speed", "no2"])


@query
def stage_accounts(spark, d):
    p = fx.panel(spark, d)
    return tidy(summary.stage_account(p, "panel", present=["pm25"]).unionByName(
        summary.stage_account(clean(spark, d), "clean", present=["pm25", "no2"])))


def _two_rules(spark, d) -> DataFrame:
    """Fold predictions of two rules that need no training."""
    folded = validate.assign_folds(_stored_features(spark, d)[0])
    return validate.rule_predictions(
        folded, "pm25", {"persistence": "pm25_lag_1h", "daily": "pm25_lag_24h"})


@query
def error_metrics(spark, d):
    return tidy(validate.error_metrics(_two_rules(spark, d)))


@query
def fold_scores(spark, d):
    return validate.fold_summary(validate.error_metrics(_two_rules(spark, d)))


@query
def guideline_ratio(spark, d):
    return tidy(fx.events(spark, d).select(
        "event_id", risk.guideline_ratio(F.col("value")).alias("ratio")))


# ---- windows -----------------------------------------------------------------------------


def _feature_columns(*names: str) -> Query:
    def run(spark, d):
        return tidy(features_with_warm_up(spark, d).select("station", "timestamp", *names))
    return run


QUERIES["target_lags"] = _feature_columns(
    *[f"pm25_lag_{k}h" for k in (1, 3, 6, 12, 24, 48, 168)])
QUERIES["trailing_means"] = _feature_columns(
    *[f"pm25_rolling_{t}" for t in ("3h", "6h", "24h", "7d")])
QUERIES["trailing_deviations"] = _feature_columns("pm25_std_24h", "pm25_std_7d")
QUERIES["trailing_precip"] = _feature_columns("precip_lag_3h")
QUERIES["pressure_change"] = _feature_columns("pressure_change_3h")
QUERIES["secondary_lags"] = _feature_columns("no2_lag_1h", "no2_lag_24h")


@query
def edge_fill(spark, d):
    p = fx.panel(spark, d).select("station", "timestamp", "temp", "no2", "o3")
    return tidy(fill_series(p, KEY, ["timestamp"], ["temp", "no2", "o3"]))


@query
def line_fill(spark, d):
    p = fx.panel(spark, d).select("station", "timestamp", "pm25")
    return tidy(fill_series(p, KEY, ["timestamp"], (), "pm25", 3))


@query
def row_position(spark, d):
    rows = fx.events(spark, d).select("event_type", "event_id", "ts")
    return row_positions(rows, ["event_type"], ["ts", "event_id"]).drop("ts")


# ---- sorts, limits, top rows -------------------------------------------------------------


@query
def latest_row(spark, d):
    return tidy(summary.latest_rows(clean(spark, d), KEY))


@query
def last_week(spark, d):
    rows = clean(spark, d).select("station", "timestamp", "pm25")
    return tidy(summary.last_rows(rows, 168, KEY))


@query
def time_order(spark, d):
    rows = clean(spark, d).select("station", "timestamp", "pm25")
    return tidy(row_positions(rows, KEY, ["timestamp"]))


@query
def tail_preview(spark, d):
    return tidy(summary.last_rows(clean(spark, d), 5, KEY))


@query
def leaderboard(spark, d):
    return validate.leaderboard(fold_scores(spark, d)).select("model", "mae", "rmse")


@query
def best_rule(spark, d):
    return validate.best_model(fold_scores(spark, d))


@query
def widening_union(spark, d):
    a = fx.readings(spark, d).select("station", "timestamp", "pm25")
    b = fx.weather(spark, d).select("timestamp", F.col("temp").alias("pm10"))
    return tidy(align.widen_union(a, b))


# ---- scalar functions --------------------------------------------------------------------


@query
def calendar_parts(spark, d):
    return fx.events(spark, d).select("event_id", *[
        c.alias(n) for n, c in scalars.calendar_parts(F.col("ts")).items()])


@query
def cyclic_calendar(spark, d):
    return tidy(fx.events(spark, d).select("event_id", *[
        c.alias(n) for n, c in scalars.cyclic_calendar(F.col("ts")).items()]))


@query
def wind_vector(spark, d):
    u, v = scalars.wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    return tidy(fx.weather(spark, d).select("timestamp", u.alias("wind_u"), v.alias("wind_v")))


@query
def weather_interactions(spark, d):
    t, h, w = F.col("temp"), F.col("humidity"), F.col("wind_speed")
    return tidy(fx.weather(spark, d).select(
        "timestamp", scalars.temp_squared(t).alias("temp_sq"),
        scalars.temp_humidity(t, h).alias("temp_x_humidity"),
        scalars.stagnation(h, w).alias("stagnation_idx")))


@query
def half_even_rounding(spark, d):
    v = (F.round(F.col("value") * 100).cast("bigint") % 1000).cast("double") / 8
    return fx.events(spark, d).select("event_id", scalars.half_even(v, 2).alias("two"),
                                      scalars.half_even(v, 1).alias("one"))


# ---- composites --------------------------------------------------------------------------


@query
def clean_rows(spark, d):
    return tidy(clean(spark, d))


@query
def feature_matrix(spark, d):
    return tidy(features(spark, d))


@query
def risk_now(spark, d):
    return tidy(latest_risk(clean(spark, d), KEY))


@query
def risk_week(spark, d):
    return tidy(recent_risk(clean(spark, d), KEY))


# ---- validation and models ---------------------------------------------------------------


@query
def expanding_folds(spark, d):
    return validate.assign_folds(clean(spark, d).select("station", "timestamp"))


@query
def series_folds(spark, d):
    rows = clean(spark, d).select("station", "timestamp")
    return validate.assign_folds_per_series(rows, KEY)


@query
def persistence_scores(spark, d):
    folded = validate.assign_folds(_stored_features(spark, d)[0])
    return validate.fold_summary(validate.error_metrics(
        validate.persistence_predictions(folded)))


def _stored_features(spark, d) -> tuple[DataFrame, list[str]]:
    """Feature rows written once, because training reads them many times."""
    path = scratch(spark)
    features(spark, d).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows, [c for c in rows.columns if c not in ("station", "timestamp", "pm25")]


def _scores(model: str) -> Query:
    def run(spark, d):
        rows, names = _stored_features(spark, d)
        folded = validate.assign_folds(rows).persist()
        scores = settle(model_scores(folded, [model], names, "pm25"))
        folded.unpersist()
        return scores
    return run


QUERIES["ridge_scores"] = _scores("ridge")
QUERIES["forest_scores"] = _scores("forest")
QUERIES["boosting_scores"] = _scores("boosting")


@query
def fold_rows_ridge(spark, d):
    rows, names = _stored_features(spark, d)
    return tidy(fold_predictions(validate.assign_folds(rows), "ridge", names, "pm25"))


@query
def experiment(spark, d):
    rows, names = _stored_features(spark, d)
    return run_experiment(rows, names, out=scratch(spark)).scores


@query
def experiment_choice(spark, d):
    """Of two models: the error from the stored fold predictions, which is chosen, and which is saved."""
    rows, _ = _stored_features(spark, d)
    out = scratch(spark)
    found = run_experiment(rows, ONE, "pm25", ExperimentSettings(models=("persistence", "ridge")), out)
    stored = validate.fold_summary(validate.error_metrics(spark.read.parquet(f"{out}/predictions")))
    saved = load_bundle(spark, f"{out}/best").name
    return stored.select("model", "mae", (F.col("model") == found.best.name).alias("chosen"),
                         (F.col("model") == saved).alias("saved"))


TWO = ["pm25_lag_1h", "temp"]


@query
def series_ridge(spark, d):
    """A ridge model of its own for every station, on two features."""
    found = ridge_by_series(_stored_features(spark, d)[0], KEY, TWO, "pm25")
    return tidy(found.select("station", "n", F.col("weights")[0].alias("w_lag"), F.col("weights")[1].alias("w_temp"),
                             "intercept"))


@query
def ridge_normal_equations(spark, d):
    """Of each fold and feature: the training rows, and whether the fit's normal equation holds there,
    from the residuals of the rows themselves."""
    rows, names = _stored_features(spark, d)
    folded = validate.assign_folds(rows)
    models = fold_ridge(folded, names, "pm25")
    copies = folded.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("test_fold < fold")
    left = F.col("pm25") - F.col("prediction")
    sums = with_prediction(copies, models, ["fold"], names).groupBy("fold").agg(
        F.count("*").alias("n"), F.sum(left).alias("rest"), F.sum(F.abs("pm25")).alias("size"), *[F.struct(
            F.sum((F.col(c) - F.lit(m)) * left).alias("product"), F.stddev_pop(c).alias("sd"),
            F.sum(F.abs((F.col(c) - F.lit(m)) * F.col("pm25"))).alias("size")).alias(f"s{i}")
            for i, (c, m) in enumerate(zip(names, folded.agg(*[F.avg(c) for c in names]).first()))])
    both = sums.join(models.select("fold", "weights"), "fold")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(
        F.col(f"s{i}.product") - F.col("weights")[i] * F.col(f"s{i}.sd") * F.col(f"s{i}.sd"))
        <= 1e-8 * F.col(f"s{i}.size") + 1e-8).alias("holds")) for i, c in enumerate(names)])
    return both.select("fold", "n", (F.abs("rest") <= 1e-8 * F.col("size")).alias("centred"),
                       F.explode(cells).alias("c")).select("fold", "n", "centred", "c.*")


ONE = ["pm25_lag_1h"]  # with one feature the fit has a closed form that SQL can state


@query
def ridge_fold_rows(spark, d):
    folded = validate.assign_folds(_stored_features(spark, d)[0])
    return tidy(fold_predictions(folded, "ridge", ONE, "pm25"))


@query
def ridge_one_feature_scores(spark, d):
    folded = validate.assign_folds(_stored_features(spark, d)[0])
    return model_scores(folded, ["ridge"], ONE, "pm25")


@query
def saved_ridge_forecast(spark, d):
    rows, path = _stored_features(spark, d)[0], scratch(spark)
    save_bundle(spark, Bundle(fit("ridge", rows, ONE, "pm25"), "ridge", tuple(ONE), "pm25"), path)
    return tidy(score_recent(load_bundle(spark, path), rows, 48, KEY))


def _train_only(spark, d) -> DataFrame:
    return train_only_rows(fx.readings(spark, d), fx.weather(spark, d), "station")


@query
def clean_train_only(spark, d):
    """Each fold's rows, cleaned with what its training rows know."""
    return tidy(_train_only(spark, d))


@query
def train_only_comparison(spark, d):
    """Two models on features of these rows."""
    path = scratch(spark)
    fold_features(_train_only(spark, d), "station").write.parquet(path)
    return train_only_scores(spark.read.parquet(path), ["persistence", "ridge"], ONE)


def _finite(column: str) -> Column:
    p = F.col(column)
    return p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))


@query
def forest_fold_checks(spark, d):
    """Of each tested fold: its rows, whether all predictions are numbers, and within the training
    targets, which a forest averages."""
    rows, names = _stored_features(spark, d)
    folded, parts = validate.assign_folds(rows).persist(), []
    for i, trained in fold_models(folded, "forest", names, "pm25").items():
        low, high = folded.where(F.col("test_fold") < i).agg(F.min("pm25"), F.max("pm25")).first()
        parts.append(trained.transform(folded.where(F.col("test_fold") == i)).agg(
            F.lit(i).alias("fold"), F.count("*").alias("n"), F.every(_finite("prediction")).alias("finite"),
            F.every(F.col("prediction").between(low - 1e-9, high + 1e-9)).alias("inside")))
    out = settle(reduce(DataFrame.unionByName, parts))
    folded.unpersist()
    return out


@query
def boosting_rounds(spark, d):
    """Of each tested fold: its rows, whether all predictions are numbers, whether the rounds tried go
    on until the best is far enough back (or the limit is reached), and whether the model kept has
    just the rounds up to the best, with the errors they had when they were tried."""
    rows, names = _stored_features(spark, d)
    folded, own = validate.assign_folds(rows).persist(), ExperimentSettings().boosting

    def one(i: int) -> DataFrame:
        train = folded.where(F.col("test_fold") < i)
        trained, tried = fit_until_patience(train, names, "pm25", own)
        kept = tail_errors(trained, train, "pm25")
        best = tried.index(min(tried)) + 1
        waited = len(tried) == own.rounds or len(tried) >= best + own.patience
        same = len(kept) == best and all(abs(a - b) <= 1e-9 * b for a, b in zip(kept, tried))
        return trained.transform(folded.where(F.col("test_fold") == i)).agg(
            F.lit(i).alias("fold"), F.count("*").alias("n"), F.every(_finite("prediction")).alias("finite"),
            F.lit(waited).alias("waited"), F.lit(same).alias("kept_best"))

    folds = range(1, ExperimentSettings().n_splits + 1)
    with ThreadPoolExecutor(len(folds)) as pool:
        out = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(one), folds))
    out = settle(out)
    folded.unpersist()
    return out


@query
def importance_checks(spark, d):
    """The whole importance table: every feature once, no negative weight, a sum of one."""
    rows, names = _stored_features(spark, d)
    table = importances(fit("forest", rows, names, "pm25"), names, spark)
    total = table.agg(F.abs(F.sum("importance") - 1) < 1e-9).first()[0]
    return table.select("feature", ((F.col("importance") >= 0) & F.lit(total)).alias("sound"))


@query
def forest_importances(spark, d):
    rows, names = _stored_features(spark, d)
    return top_importances(fit("forest", rows, names, "pm25"), names, spark)


@query
def saved_model_forecast(spark, d):
    rows, names = _stored_features(spark, d)
    path = scratch(spark)
    model = fit("ridge", rows, names, "pm25")
    save_bundle(spark, Bundle(model, "ridge", tuple(names), "pm25"), path)
    return tidy(score_recent(load_bundle(spark, path), rows, 48, KEY))


# ---- long series -------------------------------------------------------------------------

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
         "l_extendedprice"]
# A low limit, so that the plan for long series runs on the given tables as well.
CUT = ScaleSettings(max_group_rows=5_000)
MEANS = {3: "mean_3", 6: "mean_6", 24: "mean_24", 168: "mean_168"}
STDS = {24: "std_24", 168: "std_168"}


def _line_features(spark, d, key: str, scale: ScaleSettings) -> DataFrame:
    rows = fx.table(spark, d, "lineitem").select(
        *dict.fromkeys([key, *ORDER]))

    def step(df, window):
        lags = {f"lag_{k}": F.lag("l_quantity", k).over(window) for k in (1, 24, 168)}
        return trailing_stats(df, window, "l_quantity", MEANS, STDS, lags)

    out = along_series(rows, [key], ORDER, 168, step, scale)
    return tidy(out.select(*dict.fromkeys([key, "l_orderkey", "l_linenumber", "l_partkey"]),
                           "l_quantity", "lag_1", "lag_24", "lag_168",
                           *MEANS.values(), *STDS.values()))


@query
def supplier_series_features(spark, d):
    return _line_features(spark, d, "l_suppkey", ScaleSettings())


@query
def flag_series_features(spark, d):
    return _line_features(spark, d, "l_returnflag", CUT)


@query
def flag_series_quartiles(spark, d):
    rows = fx.table(spark, d, "lineitem")
    return tidy(quantiles(rows, ["l_quantity", "l_extendedprice"], (0.25, 0.5, 0.75, 0.999),
                          ["l_returnflag"], CUT))


@query
def flag_series_fill(spark, d):
    gone = F.col("l_orderkey") % 5 < 3
    rows = fx.table(spark, d, "lineitem").select(
        "l_returnflag", *ORDER, F.when(~gone, F.col("l_extendedprice")).alias("line"),
        F.when(~gone, F.col("l_tax")).alias("edge"))
    out = fill_series(rows, ["l_returnflag"], ORDER, ["edge"], "line", 3, CUT)
    return tidy(out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "line",
                           "edge"))


@query
def flag_row_position(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_returnflag", *ORDER)
    return row_positions(rows, ["l_returnflag"], ORDER, scale=CUT).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "position")


@query
def user_series_features(spark, d):
    rows = fx.events(spark, d).select("user_id", "ts", "event_id", "value")

    def step(df, window):
        return trailing_stats(df, window, "value", {3: "mean_3", 6: "mean_6"}, {6: "std_6"},
                              {"lag_1": F.lag("value", 1).over(window)})

    out = along_series(rows, ["user_id"], ["ts", "event_id"], 6, step)
    return tidy(out.drop("ts"))


# ---- streams -----------------------------------------------------------------------------


def _hour_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")]


def _streamed_hours(spark, d) -> str:
    schema = fx.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    hours = closed_hours(source.withColumn("ts", scalars.wall_clock(F.col("ts"))), "event_type",
                         "ts", ["event_id"], _hour_measures())
    base = scratch(spark)
    append_hours(hours, f"{base}/hours", f"{base}/progress").awaitTermination()
    return f"{base}/hours"


def _recorded(spark, d, landings) -> str:
    """Folder of the hours of a stream over readings that land one part after the other."""
    rows = fx.events(spark, d).select("event_id", "ts", "event_type", "value")
    base = scratch(spark)
    for part in landings:
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        record_hours(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base, f"{base}/progress",
                     "event_type", "ts", ["event_id"], _hour_measures()).awaitTermination()
    return base


@query
def hourly_stream(spark, d):
    """All hours, the last ones still open."""
    schema = fx.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    base = scratch(spark)
    record_hours(source.withColumn("ts", scalars.wall_clock(F.col("ts"))), base, f"{base}/progress",
                 "event_type", "ts", ["event_id"], _hour_measures()).awaitTermination()
    return recorded_hours(spark, base, "event_type")


def _late() -> list[Column]:
    """Most readings in two parts by time; then those of the first part that come late, some of them
    again."""
    first = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    held = F.col("event_id") % 50 == 0
    return [first & ~held, ~first, first & (F.col("event_id") % 25 == 0)]


@query
def hourly_stream_late(spark, d):
    """The hours once late readings have come."""
    return recorded_hours(spark, _recorded(spark, d, _late()), "event_type")


@query
def hourly_repairs(spark, d):
    """Just the closed hours that late readings are in, with the batch that repaired them."""
    return late_hours(spark, _recorded(spark, d, _late()))


@query
def hourly_stream_closed(spark, d):
    """The hours of the stream, and those it left open or missed."""
    path = _streamed_hours(spark, d)
    written = spark.read.parquet(path).drop("day")
    append_missed(missed_hours(fx.events(spark, d), written, "event_type", "ts", ["event_id"],
                               _hour_measures()), f"{path}-missed", 1)
    return newest_hours(written, spark.read.parquet(f"{path}-missed"), "event_type")


def _feature_stream(spark, d, parts) -> tuple[str, DataFrame]:
    base = scratch(spark)
    clean(spark, d).write.parquet(f"{base}/clean")
    rows = spark.read.parquet(f"{base}/clean")
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{base}/landed")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/landed")
        refresh_features(source, f"{base}/out", f"{base}/progress", KEY).awaitTermination()
    return f"{base}/out", rows


@query
def feature_stream(spark, d):
    first = F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    base, _ = _feature_stream(spark, d, [first, ~first])
    return tidy(spark.read.parquet(f"{base}/features").drop("batch"))


@query
def feature_stream_late(spark, d):
    """Some hours of two stations come after later ones; their features are then computed anew."""
    first = F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    held = F.col("station").isin("click", "error") & (F.day("timestamp") == 12)
    base, rows = _feature_stream(spark, d, [first & ~held, ~first | held])
    repair_late(rows, base, [0, 1], KEY)
    return tidy(current_features(spark, base, KEY))

"""One query per operator over the test tables; every result has flat, rounded columns."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.operators import (
    catalogue, cleaning, gaps, laps as lap_ops, pace, physics, preparation, quality, statistics,
    strategy, track, wear_model,
)
from stintlake.operators.boosting import BoostedTrees
from stintlake.plans import fixtures as X
from stintlake.plans.stored import scratch, stored
from stintlake.sources import readers, writers
from stintlake.streaming import live

AS_OF = date(2001, 7, 1)
#: Every season belongs to an era; each has a model of its own.
ERAS = [[1995, 1996, 1997, 1998], [1999, 2000, 2001]]
MERGE_YEARS = [1995, 1996]
DAY_S = 86400.0
GAP_BUCKET_S = 21600.0


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: C.half_up(name, n) for name, n in digits.items()})


def averaged(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds means: first far below the shown digits, so that the order in which a sum was
    formed cannot decide a tie."""
    return df.withColumns({name: C.half_up(C.half_up(name, 9), n) for name, n in digits.items()})


def points(spark: SparkSession, sf: str) -> DataFrame:
    return lap_ops.lap_points(lap_ops.drop_missing_position(X.telemetry(spark, sf)))


# Sources and sinks --------------------------------------------------------------------------


def source_schema(spark, sf):
    return readers.describe_source(X.laps(spark, sf))


def pending_races(spark, sf):
    return preparation.pending_races(X.calendar(spark, sf), X.laps(spark, sf))


def predictions_merge(spark, sf):
    new = stop_predictions(spark, sf)
    old = new.withColumn("costo_estimado_s", C.half_up(F.col("costo_estimado_s") + 1, 2))
    computed = new.where(F.col("year").isin(MERGE_YEARS))
    return strategy.merge_predictions(old, computed, MERGE_YEARS)


# Bronze preparation ---------------------------------------------------------------------------


def race_slug(spark, sf):
    return X.calendar(spark, sf).select(
        "Year", "EventName", C.slug(F.concat("EventName", F.lit(" Grand Prix"))).alias("slug")
    )


def telemetry_lap_join(spark, sf):
    joined = preparation.assemble_telemetry(
        X.samples(spark, sf), X.lap_windows(spark, sf), bucket_seconds=DAY_S
    )
    return joined.select(*K.LAP, "event_id", "Team", "Compound", "Speed")


def lap_distance(spark, sf):
    samples = X.clock_telemetry(spark, sf).drop("Distance")
    driven = preparation.lap_distance(samples)
    return rounded(driven.select(*K.LAP, "event_id", "Distance"), Distance=1)


def lap_distance_ties(spark, sf):
    """Clocks that tick every third day: many samples share an instant."""
    tick = F.lit(259200.0)
    coarse = (F.floor(F.col("SessionTime") / tick) * tick).alias("SessionTime")
    samples = X.clock_telemetry(spark, sf).select(*K.LAP, coarse, "Speed")
    return rounded(preparation.lap_distance(samples), Distance=1)


def channels_normalised(spark, sf):
    feed = X.bronze_telemetry(spark, sf).where(F.col("LapNumber").isNotNull())
    fed = preparation.normalise_channels(preparation.ensure_columns(feed.drop("DRS")))
    return fed.withColumn("Brake", F.col("Brake").cast("int")).drop("Distance")


def laps_durations(spark, sf):
    second = F.expr("INTERVAL '0.001' SECOND")
    timed = X.lap_rows(spark, sf).withColumn("LapTime", F.col("ms") * second)
    moment = F.make_date("Year", F.lit(1), F.lit(2))
    return preparation.normalise_laps(timed.drop("ms").withColumn("LapStartDate", moment))


def _feed_messages(spark, sf):
    messages = X.race_events(spark, sf)
    return messages.withColumn("Lap", F.col("LapText")).drop("LapText").withColumn(
        "Status", F.when(F.col("o_orderkey") % 3 == 0, F.lit("DEPLOYED"))
    )


def events_clean(spark, sf):
    return preparation.clean_events(_feed_messages(spark, sf)).drop("Time")


def events_flags(spark, sf):
    return preparation.events_summary(preparation.clean_events(_feed_messages(spark, sf)))


def race_status(spark, sf):
    """The state race control had called when each lap was driven."""
    return preparation.race_status(X.dated_laps(spark, sf), X.status_messages(spark, sf), "Day", 90.0)


def missing_drivers(spark, sf):
    return preparation.missing_drivers(X.roster(spark, sf), X.laps(spark, sf))


def ingest_report(spark, sf):
    report = preparation.ingest_report(X.roster(spark, sf), X.laps(spark, sf))
    return report.withColumn("faltantes", F.array_join("faltantes", ","))


def calendar_raced(spark, sf):
    return preparation.raced(X.calendar(spark, sf), AS_OF)


# Silver cleaning --------------------------------------------------------------------------------


def silver_laps(spark, sf):
    gaps_in_life = X.laps(spark, sf).withColumn(
        "TyreLife", F.when(F.col("LapNumber") % 9 != 0, F.col("TyreLife"))
    )
    return cleaning.clean_laps(gaps_in_life)


def silver_telemetry(spark, sf):
    return cleaning.clean_telemetry(X.bronze_telemetry(spark, sf))


# Data quality -------------------------------------------------------------------------------------


def sample_deltas(spark, sf):
    return rounded(quality.sample_deltas(X.telemetry(spark, sf)), arc=3, chord=3)


def sample_deltas_edges(spark, sf):
    """Null and negative distances, and a car that stands still for a third of its samples."""
    still, n = F.col("event_id") % 3 == 0, F.col("event_id")
    distance = F.when(n % 11 == 0, None).when(still, F.lit(250.0)).otherwise(
        F.col("Distance") - 400.0
    )
    odd = X.clock_telemetry(spark, sf).select(
        *K.LAP, distance.alias("Distance"),
        F.when(still, F.lit(7)).otherwise(F.col("X")).alias("X"),
        F.when(still, F.lit(9)).otherwise(F.col("Y")).alias("Y"),
    )
    return rounded(quality.sample_deltas(odd), arc=3, chord=3)


def lap_position_quality(spark, sf):
    return quality.lap_position_quality(X.telemetry(spark, sf))


def race_position_quality(spark, sf):
    return quality.race_position_quality(X.telemetry(spark, sf))


def incoherent_samples(spark, sf):
    return quality.incoherent_samples(X.telemetry(spark, sf))


def sample_spacing(spark, sf):
    spacing = quality.sample_spacing(X.telemetry(spark, sf))
    return rounded(spacing, median_step=3, min_step=3, max_step=3)


def sampling_density(spark, sf):
    return quality.sampling_density(X.telemetry(spark, sf), K.RACE)


def position_presence(spark, sf):
    return quality.position_presence(X.telemetry(spark, sf), K.RACE)


def distance_reset(spark, sf):
    return quality.distance_reset(X.telemetry(spark, sf))


def lake_profile(spark, sf):
    return quality.lake_profile(X.telemetry(spark, sf))


def telemetry_only_drivers(spark, sf):
    return quality.telemetry_only_drivers(
        X.telemetry(spark, sf), X.timed_telemetry_laps(spark, sf)
    )


def missing_position(spark, sf):
    return quality.missing_position(X.telemetry(spark, sf))


# Pace and wear ------------------------------------------------------------------------------------


def rule_107_circuit(spark, sf):
    dry = pace.dry_only(X.silver_laps(spark, sf))
    return pace.rule_107(dry, ["GrandPrix"]).select(*K.LAP, "LapTime")


def rule_107_race(spark, sf):
    return pace.rule_107(X.silver_laps(spark, sf), K.RACE).select(*K.LAP, "LapTime")


def dry_laps(spark, sf):
    return pace.dry_only(X.laps(spark, sf)).select(*K.LAP, "Compound")


def fuel_adjusted(spark, sf):
    adjusted = pace.fuel_adjust(pace.rule_107(X.silver_laps(spark, sf), K.RACE), K.RACE)
    return rounded(adjusted.select(*K.LAP, "LapTimeFuelAdj"), LapTimeFuelAdj=3)


def pace_delta(spark, sf):
    delta = wear_model.training_laps(X.laps(spark, sf))
    return rounded(
        delta.select(*K.LAP, "LapTimeFuelAdj", "LapTimeDelta"), LapTimeFuelAdj=3, LapTimeDelta=3
    )


def race_names(spark, sf):
    return pace.race_names(X.named_races(spark, sf))


def _warehouse_laps(spark, sf):
    return pace.warehouse_laps(X.silver_laps(spark, sf), X.race_name_table(spark, sf))


def warehouse_laps(spark, sf):
    return rounded(_warehouse_laps(spark, sf), LapTimeFuelAdj=3)


def warehouse_predictions(spark, sf):
    return pace.warehouse_predictions(stop_predictions(spark, sf), X.race_name_table(spark, sf))


def warehouse_summary(spark, sf):
    return pace.warehouse_summary(_warehouse_laps(spark, sf))


def bi_lap_curve(spark, sf):
    curve = pace.bi_lap_curve(_warehouse_laps(spark, sf), Compound=K.DRY_COMPOUNDS)
    return averaged(curve, mean_lap_time=4)


def bi_wear_curve(spark, sf):
    curve = pace.bi_wear_curve(_warehouse_laps(spark, sf), Compound=K.DRY_COMPOUNDS)
    return averaged(curve, mean_delta=4)


def _bi_cube(spark, sf):
    return stored(
        spark, sf, "bi-cube", lambda: pace.bi_cube(pace.bi_partials(_warehouse_laps(spark, sf)))
    )


def bi_cube(spark, sf):
    return _bi_cube(spark, sf)


def bi_wear_from_cube(spark, sf):
    """The wear curve of dry tyres, answered by the stored cube."""
    curve = pace.bi_answer(_bi_cube(spark, sf), "TyreLife", Compound=K.DRY_COMPOUNDS)
    return averaged(curve.select("TyreLife", "mean_delta", "laps"), mean_delta=4)


def bi_race_from_cube(spark, sf):
    """Lap by lap on soft tyres in two seasons."""
    chosen = {"Temporada": ["1996", "1999"], "Compound": "SOFT"}
    curve = pace.bi_answer(_bi_cube(spark, sf), "LapNumber", **chosen)
    return averaged(curve.select("LapNumber", "mean_lap_time", "laps"), mean_lap_time=4)


def season_statistics(spark, sf):
    """Seasons from the sketches of their races, and whether each figure is as near to the exact
    one as stated."""
    laps = X.silver_laps(spark, sf)
    root = scratch(spark, "sketches")
    statistics.store_sketches(statistics.race_sketches(laps), root)
    found = statistics.figures(
        statistics.merged(statistics.read_sketches(spark, root), ["Year"]), ["Year"]
    )
    names = list(statistics.QUANTILES)
    ranks = laps.join(found.select("Year", *names), "Year").groupBy("Year").agg(
        F.count("LapTime").alias("_n"), F.count_distinct("Driver").alias("_drivers"),
        *[F.count_if(F.col("LapTime") < F.col(name)).alias(f"_{name}_below") for name in names],
        *[F.count_if(F.col("LapTime") <= F.col(name)).alias(f"_{name}_upto") for name in names],
    )
    room = F.lit(statistics.RANK_ERROR) + F.lit(1.0) / F.col("_n")

    def near(name, share):
        low = F.col(f"_{name}_below") / F.col("_n") - room
        return F.lit(share).between(low, F.col(f"_{name}_upto") / F.col("_n") + room).alias(f"{name}_near")

    drivers = F.abs(F.col("drivers") - F.col("_drivers")) <= 1 + statistics.DISTINCT_ERROR * F.col("_drivers")
    return averaged(
        found.join(ranks, "Year").select(
            "Year", "laps", "mean_time", "fastest", "slowest",
            *[near(name, share) for name, share in statistics.QUANTILES.items()],
            drivers.alias("drivers_near"),
        ),
        mean_time=4,
    )


def bi_stop_error(spark, sf):
    return rounded(pace.bi_stop_error(stop_predictions(spark, sf)), mean_error=4, mean_bias=4)


def wear_points(spark, sf):
    return pace.wear_points(X.laps(spark, sf))


# Wear model -----------------------------------------------------------------------------------------


FIRST_SPLIT = wear_model.WearParams(
    trees=1, depth=1, rate=1.0, row_share=1.0, column_share=1.0, least_rows=1
)


def _training(spark, sf):
    laps = wear_model.with_era(X.laps(spark, sf), ERAS)
    return wear_model.features(wear_model.training_laps(laps))


def _training_rows(spark, sf):
    """What splits, models and their error use of the rows."""
    used = ["era", *K.LAP, "TyreLife", "Stint", *wear_model.compound_columns(K.DRY_COMPOUNDS), K.MODEL_TARGET]
    return stored(spark, sf, "training", lambda: _training(spark, sf).select(*used))


def _split(spark, sf):
    return wear_model.holdout_split(_training_rows(spark, sf))


def _model(spark, sf):
    """The published model of every era, trained once in a session."""
    trees = stored(
        spark, sf, "wear-trees",
        lambda: wear_model.train_wear(_split(spark, sf).where(~F.col("validation"))).trees,
    )
    return BoostedTrees(trees, wear_model.ERA)


def era_laps(spark, sf):
    return wear_model.with_era(X.silver_laps(spark, sf), ERAS).select("era", *K.LAP)


def era_selected(spark, sf):
    """The laps of one era, picked by its seasons."""
    laps = wear_model.select_era(X.silver_laps(spark, sf), ERAS[1])
    return laps.select(F.lit(wear_model.era_name(ERAS[1])).alias("era"), *K.LAP)


def model_features(spark, sf):
    columns = ["era", *K.LAP, "TyreLife", "Stint", *wear_model.compound_columns(K.DRY_COMPOUNDS)]
    return rounded(_training(spark, sf).select(*columns, "LapTimeDelta"), LapTimeDelta=3)


def holdout_circuit(spark, sf):
    return wear_model.holdout_circuit(_training_rows(spark, sf))


def holdout_split(spark, sf):
    return _split(spark, sf).select("era", *K.LAP, "validation")


def random_holdout(spark, sf):
    return wear_model.random_holdout(_training_rows(spark, sf)).select("era", *K.LAP, "validation")


def baseline_mae(spark, sf):
    return averaged(wear_model.baseline_mae(_split(spark, sf)), baseline=4)


def wear_cells(spark, sf):
    """What the trees are grown from."""
    return wear_model.wear_cells(_split(spark, sf).where(~F.col("validation")))


def wear_first_split(spark, sf):
    """The first split of a tree over all training rows: node 1 with its feature, its children with
    their values, and the mean (node 0)."""
    rows = _split(spark, sf).where(~F.col("validation"))
    trees = wear_model.train_wear(rows, FIRST_SPLIT).trees
    node = F.when(F.col("tree") == 0, 0).otherwise(F.col("node")).cast("int").alias("node")
    return rounded(
        trees.select("era", node, "feature", "threshold", "gain", "rows", "value"), gain=4, value=6
    )


def wear_model_predictions(spark, sf):
    scored = _model(spark, sf).transform(_split(spark, sf).where(F.col("validation")))
    return scored.select("era", *K.LAP, "LapTimeDelta", F.col("prediction").alias("LapTimeDeltaHat"))


def wear_metrics(spark, sf):
    return wear_model.evaluate(_model(spark, sf), _split(spark, sf))


def metrics_record(spark, sf):
    model, split = _model(spark, sf), _split(spark, sf)
    record = wear_model.metrics_record(wear_model.evaluate(model, split), split, model, None)
    return record.select(
        "era", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "target",
        "mae_segundos", "baseline_segundos", "vueltas_entrenamiento", "vueltas_validacion",
        F.array_join("circuitos", ",").alias("circuitos"),
        F.array_join("features", ",").alias("features"),
    )


def wear_importances(spark, sf):
    return _model(spark, sf).importances()


def wear_grid(spark, sf):
    return wear_model.prediction_grid(spark, _model(spark, sf))


def grid_shape(spark, sf):
    """How many cells the grids of the trained models have of each compound and stint."""
    cells = wear_grid(spark, sf).where(F.col("pred").isNotNull())
    return cells.groupBy("era", "compound", "stint").agg(
        F.count(F.lit(1)).alias("cells"), F.min("tyre").alias("first_tyre"),
        F.max("tyre").alias("last_tyre"), F.min("lap").alias("first_lap"),
        F.max("lap").alias("last_lap"),
    )


def regression_metrics(spark, sf):
    measured = wear_model.regression_metrics(X.predicted_laps(spark, sf), "LapTime", "LapTimeHat")
    return averaged(measured, rmse=6, mae=6, r2=6, mape=6)


def metrics_dry(spark, sf):
    measured = wear_model.metrics_dry(X.predicted_laps(spark, sf), "LapTime", "LapTimeHat")
    return averaged(measured, rmse=6, mae=6, r2=6, mape=6)


# Strategy -------------------------------------------------------------------------------------------


def _requests(spark, sf):
    return strategy.stop_requests(X.silver_laps(spark, sf))


def stop_requests(spark, sf):
    return _requests(spark, sf)


def stint_cost(spark, sf):
    requests = _requests(spark, sf).select(
        *K.SESSION_DRIVER, F.col("first_compound").alias("compound"), F.lit(1).alias("stint"),
        "start_tyre", F.col("start_lap").alias("from_lap"), F.col("total_laps").alias("to_lap"),
    )
    return rounded(strategy.stint_cost(requests, X.formula_grid(spark)), cost=3)


def best_stop(spark, sf):
    solved = strategy.best_stop(_requests(spark, sf), X.formula_grid(spark))
    return solved.select(*K.SESSION_DRIVER, "pit_window", "cost")


def pit_loss(spark, sf):
    return X.named_races(spark, sf).select(
        *K.RACE, C.pit_loss("GrandPrix").alias("pit_loss")
    )


def wear_slope(spark, sf):
    slopes = strategy.wear_slope(_requests(spark, sf), X.formula_grid(spark))
    return slopes.select(*K.SESSION_DRIVER, "first_compound", "start_lap", "wear_s_lap")


def stop_predictions(spark, sf):
    return strategy.predict_stops(X.silver_laps(spark, sf), X.formula_grid(spark))


def stop_summary(spark, sf):
    return strategy.stop_summary(stop_predictions(spark, sf))


def _era_records(spark, sf):
    """A metrics record per era with the predictor of `predicted_laps` as the model."""
    laps = X.predicted_laps(spark, sf)
    first = F.col("Year") <= 1998
    error = F.avg(F.abs(F.col("LapTime") - F.col("LapTimeHat")))
    return laps.groupBy(F.when(first, "1995-1998").otherwise("1999-2001").alias("era")).agg(
        F.array_sort(F.collect_set("Year")).alias("years"),
        C.half_up(C.half_up(error, 9), 3).alias("mae_segundos"),
    )


def strategy_lookup(spark, sf):
    gold = stored(spark, sf, "predictions", lambda: stop_predictions(spark, sf))
    found = strategy.strategy_lookup(
        gold, _era_records(spark, sf), 1996, "nation_15", "s0000"
    )
    return found.select(
        "year", "gp", "driver", "pit_window", "pit_real",
        F.col("resumen.predicciones_totales").alias("predicciones_totales"),
        F.col("resumen.mae_vueltas").alias("mae_vueltas"),
        F.col("modelo.era").alias("era"),
        F.col("modelo.mae_segundos").alias("mae_segundos"),
    )


def strategy_card(spark, sf):
    cards = strategy.strategy_card(stop_predictions(spark, sf))
    return rounded(cards, window_pct=4, real_pct=4)


# Catalogue --------------------------------------------------------------------------------------------


def _team_laps(spark, sf):
    """Laps in which drivers change team during a race, so the count decides."""
    swap = F.col("LapNumber") % 3 == 0
    other = F.concat(F.lit("T"), (F.substring("Driver", 2, 4).cast("int") % 7).cast("string"))
    return X.silver_laps(spark, sf).withColumn("Team", F.when(swap, other).otherwise(
        F.when(F.col("LapNumber") % 2 == 0, F.lit("T9")).otherwise(F.col("Team"))
    ))


def team_by_race(spark, sf):
    return catalogue.team_by_race(_team_laps(spark, sf))


def team_by_season(spark, sf):
    return catalogue.team_by_season(catalogue.team_by_race(_team_laps(spark, sf)))


def race_laps(spark, sf):
    return catalogue.race_laps(X.silver_laps(spark, sf))


def driver_names(spark, sf):
    return catalogue.driver_names(
        X.roster(spark, sf), X.calendar(spark, sf), X.catalogue_telemetry(spark, sf)
    )


def catalogue_races(spark, sf):
    return catalogue.catalogue_races(
        X.calendar(spark, sf), X.catalogue_telemetry(spark, sf), X.silver_laps(spark, sf), AS_OF
    )


def catalogue_drivers(spark, sf):
    return catalogue.catalogue_drivers(
        X.calendar(spark, sf), X.catalogue_telemetry(spark, sf), X.silver_laps(spark, sf),
        driver_names(spark, sf),
    )


def teams(spark, sf):
    return catalogue.teams(catalogue_drivers(spark, sf))


def catalogue_summary(spark, sf):
    return catalogue.catalogue_summary(catalogue_races(spark, sf))


def default_race(spark, sf):
    return catalogue.default_race(catalogue_races(spark, sf))


def drivers_by_team(spark, sf):
    return catalogue.drivers_by_team(X.calendar(spark, sf), catalogue_drivers(spark, sf))


def silver_roundtrip(spark, sf):
    """Silver laps as they come back from the lake."""
    root = scratch(spark, "silver")
    writers.write_silver(X.silver_laps(spark, sf), root, "laps")
    return readers.read_silver(spark, root, "laps")


def _silver_telemetry(spark, sf):
    root = scratch(spark, "silver")
    writers.write_silver(cleaning.clean_telemetry(X.bronze_telemetry(spark, sf)), root, "telemetry")
    return readers.read_silver(spark, root, "telemetry")


def silver_telemetry_roundtrip(spark, sf):
    """Silver telemetry, partitioned by driver, as it comes back from the lake."""
    return _silver_telemetry(spark, sf)


def partition_file_counts(spark, sf):
    """Files behind each driver folder of the lake."""
    files = quality.partition_files(_silver_telemetry(spark, sf), K.SESSION_DRIVER)
    return files.select(*K.SESSION_DRIVER, F.col("files").cast("int").alias("files"))


def catalogue_roundtrip(spark, sf):
    """The catalogue as it comes back from its gold folder, drivers as one text."""
    path = scratch(spark, "catalogue")
    whole = catalogue.catalogue(catalogue_races(spark, sf), catalogue_drivers(spark, sf))
    writers.write_catalogue(whole, path)
    driver = F.transform("pilotos", lambda p: F.concat_ws(":", p["code"], p["team"], p["name"]))
    read = readers.read_gold(spark, path, "circuitos")
    return read.withColumn("pilotos", F.array_join(driver, ","))


def predictions_roundtrip(spark, sf):
    """Stop predictions as they come back from their gold folder."""
    path = scratch(spark, "predictions")
    writers.write_rows(stop_predictions(spark, sf), f"{path}/predicciones")
    return readers.read_gold(spark, path, "predicciones")


# Lap serving ------------------------------------------------------------------------------------------


def laps_available(spark, sf):
    return lap_ops.laps_available(X.telemetry(spark, sf))


def middle_lap(spark, sf):
    return lap_ops.middle_lap(X.telemetry(spark, sf))


def selected_lap(spark, sf):
    return lap_ops.select_lap(X.telemetry(spark, sf)).select(*K.LAP, "Distance", "Speed", "X", "Y")


def unknown_lap(spark, sf):
    return lap_ops.unknown_lap(X.telemetry(spark, sf), 4)


def lap_points(spark, sf):
    return points(spark, sf)


def lap_bounds(spark, sf):
    return lap_ops.lap_bounds(X.telemetry(spark, sf))


def fastest_lap(spark, sf):
    chosen = lap_ops.fastest_lap(X.timed_telemetry_laps(spark, sf), X.telemetry(spark, sf))
    return rounded(chosen.select(*K.LAP, "LapTime", "Distance", "Speed"), LapTime=3)


def head_to_head(spark, sf):
    return lap_ops.head_to_head(
        X.timed_telemetry_laps(spark, sf), X.telemetry(spark, sf), "D0024", "D0048"
    )


def head_to_head_aligned(spark, sf):
    side_by_side = lap_ops.head_to_head_aligned(
        X.timed_telemetry_laps(spark, sf), X.telemetry(spark, sf), "D0024", "D0048"
    )
    shown = {f"{c}_{s}": 4 for c in ("speed", "throttle") for s in "ab"}
    return rounded(side_by_side, **shown, speed_gap=4)


def resampled_laps(spark, sf):
    """All laps on one grid of distances."""
    return rounded(lap_ops.on_grid(X.telemetry(spark, sf), 25.0), Speed=4, Throttle=4)


def lap_progress(spark, sf):
    progress = lap_ops.lap_progress(points(spark, sf))
    return rounded(
        progress.select(*K.LAP, "distance", "progress_pct", "distance_ratio"),
        progress_pct=4, distance_ratio=4,
    )


# Derived physics ----------------------------------------------------------------------------------------


def neighbours(spark, sf):
    found = physics.neighbours(points(spark, sf))
    return found.select(
        *K.LAP, "distance",
        F.col("before.dm").alias("before_dm"), F.col("before.x").alias("before_x"),
        F.col("after.dm").alias("after_dm"), F.col("after.x").alias("after_x"),
    )


def lateral_g_raw(spark, sf):
    return rounded(physics.lateral_g(points(spark, sf)).select(*K.LAP, "distance", "g_lat"),
                   g_lat=4)


def longitudinal_g_raw(spark, sf):
    return rounded(physics.longitudinal_g(points(spark, sf)).select(*K.LAP, "distance", "g_lon"),
                   g_lon=4)


def g_smoothed(spark, sf):
    smooth = physics.smoothed_forces(points(spark, sf))
    return rounded(smooth.select(*K.LAP, "distance", "g_lat", "g_lon"), g_lat=4, g_lon=4)


def lap_enriched(spark, sf):
    return physics.enrich(points(spark, sf)).select(*K.LAP, "distance", "g_lat", "g_lon")


def _finite(name):
    return F.when(F.abs(F.col(name)) != float("inf"), C.half_up(name, 2))


def g_diagnostic(spark, sf):
    found = physics.g_diagnostic(points(spark, sf))
    shown = rounded(found, p90_raw=4, max_raw=4, median_g=4, p90_g=4, max_g=4, fastest_g=4,
                    slowest_g=4)
    return shown.withColumns(
        {name: _finite(name) for name in ("fastest_radius_m", "slowest_radius_m")}
    )


def g_top5(spark, sf):
    top = physics.g_top(points(spark, sf))
    return rounded(top, g=4).withColumn("radius_m", _finite("radius_m"))


def gauges(spark, sf):
    read = physics.gauges(physics.enrich(points(spark, sf)))
    return rounded(
        read.select(*K.LAP, "distance", "deceleration_g", "high_load", "drs_open", "rev_ratio",
                    "lit_lights", "wheel_turns_s", "aero_load_pct"),
        deceleration_g=2, rev_ratio=4, wheel_turns_s=3, aero_load_pct=3,
    )


# Track geometry -------------------------------------------------------------------------------------------


def track_projected(spark, sf):
    drawn = track.project_track(points(spark, sf))
    return rounded(
        drawn.select(*K.LAP, "distance", "map_x", "map_y", "units_per_metre"),
        map_x=3, map_y=3, units_per_metre=4,
    )


def track_segments(spark, sf):
    return track.track_segments(points(spark, sf))


def braking_zones(spark, sf):
    return track.braking_zones(points(spark, sf))


def nearest_sample(spark, sf):
    """Asks for the point nearest to every point, moved by (3, 4)."""
    drawn = track.project_track(points(spark, sf))
    asked = drawn.select(
        *K.LAP,
        F.round(F.col("distance") * 10).cast("long").alias("query_id"),
        (F.col("map_x") + 3).alias("qx"),
        (F.col("map_y") + 4).alias("qy"),
    )
    return rounded(track.nearest_sample(drawn, asked), map_distance=3)


# Gaps -------------------------------------------------------------------------------------------------------


def live_laps(spark, sf):
    """Laps as a stream of shuffled sample files leaves them. The files come in three runs; each
    holds samples of all laps, most of them late for laps that the run before has closed."""
    root = scratch(spark, "live")
    arriving = X.live_samples(spark, sf)
    for part in range(3):
        now = arriving.where(F.col("part") == part).drop("part")
        now.write.mode("append").parquet(f"{root}/samples")
        # No sample is too late here: the test tables' clock spans months.
        live.follow(
            spark, f"{root}/samples", f"{root}/laps", f"{root}/seen", horizon_s=10**9
        ).awaitTermination()
    known = live.shown(live.read_laps(spark, f"{root}/laps"))
    return rounded(
        known.select(*K.LAP, "samples", "first_us", "last_us", "top_speed", "seconds", "mean_speed",
                     "throttle_share", "braking_share", "metres"),
        seconds=3, mean_speed=4, throttle_share=4, braking_share=4,
    )


def gap_ahead(spark, sf):
    gap = gaps.gap_ahead(X.clock_telemetry(spark, sf), GAP_BUCKET_S)
    return rounded(gap, covered_m=1, gap_m=1)


QUERIES = {
    f.__name__: f
    for f in [
        source_schema, pending_races, predictions_merge,
        race_slug, telemetry_lap_join, lap_distance, lap_distance_ties, channels_normalised, laps_durations,
        events_clean, events_flags, race_status, missing_drivers, ingest_report, calendar_raced,
        silver_laps, silver_telemetry,
        sample_deltas, sample_deltas_edges, lap_position_quality, race_position_quality, incoherent_samples,
        sample_spacing, sampling_density, position_presence, distance_reset, lake_profile,
        telemetry_only_drivers, missing_position,
        rule_107_circuit, rule_107_race, dry_laps, fuel_adjusted, pace_delta, race_names,
        warehouse_laps, warehouse_predictions, warehouse_summary, bi_lap_curve, bi_wear_curve,
        bi_cube, bi_wear_from_cube, bi_race_from_cube, season_statistics,
        bi_stop_error, wear_points,
        era_laps, era_selected, model_features, holdout_circuit, holdout_split, random_holdout, baseline_mae,
        wear_cells, wear_first_split,
        wear_model_predictions, wear_metrics, metrics_record, wear_importances, wear_grid, grid_shape,
        regression_metrics, metrics_dry,
        stop_requests, stint_cost, best_stop, pit_loss, wear_slope, stop_predictions,
        stop_summary, strategy_lookup, strategy_card,
        team_by_race, team_by_season, race_laps, driver_names, catalogue_races,
        catalogue_drivers, teams, catalogue_summary, default_race, drivers_by_team,
        silver_roundtrip, silver_telemetry_roundtrip, partition_file_counts, catalogue_roundtrip, predictions_roundtrip,
        laps_available, middle_lap, selected_lap, unknown_lap, lap_points, lap_bounds,
        fastest_lap, head_to_head, head_to_head_aligned, resampled_laps, lap_progress,
        neighbours, lateral_g_raw, longitudinal_g_raw, g_smoothed, lap_enriched, g_diagnostic,
        g_top5, gauges,
        track_projected, track_segments, braking_zones, nearest_sample,
        live_laps, gap_ahead,
    ]
}

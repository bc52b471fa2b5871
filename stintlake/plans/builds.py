"""The jobs of the lake: bronze to silver, silver to gold, silver to model, gold to warehouse."""

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.operators import catalogue, cleaning, pace, strategy, wear_model
from stintlake.sources import readers, writers

log = logging.getLogger(__name__)


def build_silver(
    spark: SparkSession, bronze: str, silver: str, year: int, gps: list[str] | None = None
) -> dict[str, int]:
    """Cleans a season, or some of its races, into the silver tables: one job per table, not
    one per race. A race whose files don't fit is reported and left as it is; the others are
    written. Returns the rows written per table."""
    rows = {}
    steps = {
        "laps": cleaning.clean_laps,
        "events": lambda df: df,
        "telemetry": cleaning.clean_telemetry,
    }
    for kind, clean in steps.items():
        raw, races, rejected = readers.read_valid_bronze(spark, bronze, year, gps, kind)
        for file, why in rejected.items():
            log.warning("%s left out: %s", file, why)
        if raw is None:
            log.warning("no bronze %s for %s %s", kind, year, gps or "(all races)")
        else:
            written = writers.write_silver(clean(raw), silver, kind, races)
            rows[kind] = written.get["rows"]
    return rows


def build_catalogue(
    spark: SparkSession, silver: str, calendar: DataFrame, results: DataFrame, as_of, path: str
) -> None:
    """Writes the nested catalogue of the seasons in the calendar."""
    telemetry = readers.read_silver(spark, silver, "telemetry")
    laps = readers.read_silver(spark, silver, "laps")
    races = catalogue.catalogue_races(calendar, telemetry, laps, as_of)
    names = catalogue.driver_names(results, calendar, telemetry)
    drivers = catalogue.catalogue_drivers(calendar, telemetry, laps, names)
    writers.write_catalogue(catalogue.catalogue(races, drivers), path)


def train_era(
    spark: SparkSession,
    silver: str,
    models: str,
    years: list[int],
    holdout: str | None = None,
    params: wear_model.WearParams = wear_model.WearParams(),
) -> None:
    """Trains the wear model of an era and stores it with its metrics.

    A whole circuit is kept for validation; with a single circuit, a random fifth of the laps.
    """
    laps = wear_model.with_era(readers.read_silver(spark, silver, "laps"), [years])
    rows = wear_model.features(wear_model.training_laps(laps)).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        several = len(rows.select("GrandPrix").distinct().take(2)) > 1
        if several:
            chosen = wear_model.holdout_circuit(rows, holdout).first()
            holdout = chosen["GrandPrix"] if chosen else holdout
            split = wear_model.holdout_split(rows, holdout)
        else:
            holdout = None
            split = wear_model.random_holdout(rows)
        era = wear_model.era_name(years)
        writers.save_trees(wear_model.train_wear(split.where(~F.col("validation")), params), models, era)
        model = writers.load_model(spark, models, era)
        record = wear_model.metrics_record(wear_model.evaluate(model, split), laps, model, holdout)
        writers.save_metrics(record, models, era)
    finally:
        rows.unpersist()


def build_predictions(
    spark: SparkSession, silver: str, models: str, years: list[int], path: str, previous: str | None
) -> None:
    """Predicts the stops of the seasons of an era; seasons in `previous` are kept. `path` must
    not be the folder `previous` is read from."""
    laps = wear_model.select_era(readers.read_silver(spark, silver, "laps"), years)
    model = writers.load_model(spark, models, wear_model.era_name(years))
    rows = strategy.predict_stops(laps, wear_model.prediction_grid(spark, model).drop("era"))
    if previous is not None:
        kept = readers.read_gold(spark, previous, "predicciones")
        rows = strategy.merge_predictions(kept, rows, years)
    writers.write_rows(rows, f"{path}/predicciones")
    summary = strategy.stop_summary(readers.read_gold(spark, path, "predicciones"))
    writers.write_rows(summary, f"{path}/resumen")


def load_warehouse(
    spark: SparkSession, silver: str, catalogue_path: str, predictions_path: str, database: str
) -> dict[str, bool]:
    """Replaces the warehouse tables `vueltas` and `predicciones`."""
    races = readers.read_gold(spark, catalogue_path, "circuitos")
    names = races.select("slug", "nombre").distinct()
    laps = readers.read_silver(spark, silver, "laps")
    predictions = readers.read_gold(spark, predictions_path, "predicciones")
    return {
        "vueltas": writers.load_table(
            pace.warehouse_laps(laps, names, compat=True), f"{database}.vueltas"
        ),
        "predicciones": writers.load_table(
            pace.warehouse_predictions(predictions, names), f"{database}.predicciones"
        ),
    }

"""Incremental silver: new bronze files are picked up once, re-runs are safe."""

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stintlake import constants as K
from stintlake import schemas
from stintlake.functions import columns as C
from stintlake.operators import cleaning
from stintlake.sources import readers, writers

log = logging.getLogger(__name__)

CLEAN = {
    "laps": cleaning.clean_laps,
    "telemetry": cleaning.clean_telemetry,
    "events": lambda df: df,
}


def _refresh(spark: SparkSession, bronze: str, silver: str, kind: str, arrived: DataFrame) -> None:
    """Rebuilds the silver partitions of the races that got new files.

    A race may arrive in several files, and a partition is replaced as a whole: so all bronze
    files of a touched race are read again, not just the new ones. The list of touched races
    is short: a calendar has a few dozen races per season.
    """
    touched = arrived.select(*K.RACE).distinct().withColumn("GrandPrix", C.slug("GrandPrix"))
    seasons: dict[int, list[str]] = {}
    for race in touched.toLocalIterator():
        seasons.setdefault(race["Year"], []).append(race["GrandPrix"])
    for year, gps in sorted(seasons.items()):
        whole, races, rejected = readers.read_valid_bronze(spark, bronze, year, gps, kind)
        for file, why in rejected.items():
            log.warning("%s left out: %s", file, why)
        if whole is not None:
            writers.write_silver(CLEAN[kind](whole), silver, kind, races)
            log.info("%s: %d races of %s refreshed", kind, len(races), year)


def refresh_silver(
    spark: SparkSession, bronze: str, silver: str, checkpoint: str, kind: str = "laps"
) -> StreamingQuery:
    """Processes all bronze files that arrived since the last run, then stops.

    `checkpoint` is a folder on shared storage; it remembers which files were seen.
    """
    files = readers.bronze_glob(bronze, "*", None, kind)
    arrived = spark.readStream.schema(schemas.BRONZE[kind]).parquet(files)
    return (
        arrived.writeStream.foreachBatch(
            lambda batch, _: _refresh(batch.sparkSession, bronze, silver, kind, batch)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Gap to the car ahead, on the clock all cars of a session share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import ordered
from stintlake.functions.groups import exact_quantiles

LENGTH_BIN_M = 100.0
PIECE_M = 1000.0


def lap_lengths(telemetry: DataFrame) -> DataFrame:
    """Per race: the median of the distances at which laps ended, so that a few bad samples do
    not decide."""
    ends = telemetry.groupBy(*K.LAP).agg(F.max("Distance").alias("_end"))
    return exact_quantiles(ends, K.RACE, "_end", {"_length": 0.5}, LENGTH_BIN_M)


def gap_ahead(telemetry: DataFrame, bucket_seconds: float) -> DataFrame:
    """Per race and instant, every `bucket_seconds`: each running car's place, the car ahead and
    the gap in m.

    The way a car has covered is its finished laps times the lap length plus its distance in the
    lap. At an instant it lies between the car's samples before and after, by the time passed;
    a car takes part from its first to its last sample.
    """
    width = F.lit(float(bucket_seconds))
    covered = (F.col("LapNumber") - 1) * F.col("_length") + F.col("Distance")
    samples = (
        telemetry.select(*K.SESSION_DRIVER, "SessionTime", "LapNumber", "Distance")
        .join(lap_lengths(telemetry), K.RACE)
        .withColumn("_covered", covered)
    )
    placed = ordered.cut(samples, ordered.bucket("SessionTime", bucket_seconds))
    order = ["SessionTime", "LapNumber", "Distance"]
    steps = ordered.previous(
        placed, K.SESSION_DRIVER, order, ["SessionTime", "_covered"], "_from"
    ).where(F.col("_from.SessionTime") < F.col("SessionTime"))
    first = F.ceil(F.col("_from.SessionTime") / width)
    last = F.ceil(F.col("SessionTime") / width) - 1
    share = (F.col("bucket") * width - F.col("_from.SessionTime")) / (
        F.col("SessionTime") - F.col("_from.SessionTime")
    )
    places = (
        steps.where(first <= last)
        .withColumn("bucket", F.explode(F.sequence(first, last)))
        .select(
            *K.SESSION_DRIVER,
            "bucket",
            (
                F.col("_from._covered") + (F.col("_covered") - F.col("_from._covered")) * share
            ).alias("covered_m"),
        )
    )
    group = [*K.RACE, "bucket"]
    behind = places.withColumn("_behind", -F.col("covered_m"))
    ahead = ordered.previous(
        ordered.cut(behind, ordered.bucket("_behind", PIECE_M)),
        group, ["_behind", "Driver"], ["Driver", "covered_m"], "_ahead",
    )
    return ahead.select(
        *K.RACE,
        "bucket",
        "Driver",
        "covered_m",
        F.col("_ahead.Driver").alias("driver_ahead"),
        (F.col("_ahead.covered_m") - F.col("covered_m")).alias("gap_m"),
    )

"""Statistics of races that merge: quantiles and distinct counts from sketches stored per race.

A race's sketches are made from its own laps alone and stored beside those of other races; figures
of a season, a circuit or everything merge the sketches of the races in question and read no lap
again. Ranks of quantiles are off by RANK_ERROR of all values at most (99 % of the time, for the size
SKETCH_K), distinct counts by DISTINCT_ERROR; rows, sums and extremes are exact.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.sources import folders

SKETCH_K = 800
RANK_ERROR = 0.005
HLL_BITS = 14
DISTINCT_ERROR = 0.03
QUANTILES = {"p10": 0.1, "median": 0.5, "p90": 0.9}

SKETCHES = (
    "laps long, timed long, time_ms long, fastest double, slowest double, times binary, drivers binary, "
    "Year int, GrandPrix string"
)


def race_sketches(laps: DataFrame, value: str = "LapTime") -> DataFrame:
    """A row per race: counts, sum and extremes of the lap times, and sketches of the lap times and
    of the drivers. Null times count as laps only."""
    return laps.groupBy(*K.RACE).agg(
        F.count(F.lit(1)).alias("laps"),
        F.count(value).alias("timed"),
        F.coalesce(F.sum(F.round(F.col(value) * 1000).cast("long")), F.lit(0)).alias("time_ms"),
        F.min(value).alias("fastest"),
        F.max(value).alias("slowest"),
        F.kll_sketch_agg_double(F.col(value), SKETCH_K).alias("times"),
        F.hll_sketch_agg("Driver", HLL_BITS).alias("drivers"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of several races as one, for each group."""
    return sketches.groupBy(*by).agg(
        F.sum("laps").alias("laps"), F.sum("timed").alias("timed"), F.sum("time_ms").alias("time_ms"),
        F.min("fastest").alias("fastest"), F.max("slowest").alias("slowest"),
        F.kll_merge_agg_double(F.col("times"), SKETCH_K).alias("times"),
        F.hll_union_agg("drivers").alias("drivers"),
    )


def figures(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Laps, mean, extremes, quantiles and number of drivers of each row of sketches."""
    whole = F.nullif(F.col("timed"), F.lit(0))
    return sketches.select(
        *by, "laps", "timed", (F.col("time_ms") / whole / F.lit(1000.0)).alias("mean_time"),
        "fastest", "slowest",
        *[
            F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("times", F.lit(share))).alias(name)
            for name, share in QUANTILES.items()
        ],
        F.hll_sketch_estimate("drivers").alias("drivers"),
    )


def store_sketches(sketches: DataFrame, root: str) -> None:
    """Replaces the stored sketches of the races at hand; those of others stay."""
    (
        sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*K.RACE).parquet(f"{root}/statistics")
    )


def refresh(silver_laps: DataFrame, root: str, races: list[tuple[int, str]]) -> None:
    """Makes the sketches of some races anew, from their laps alone."""
    wanted = F.lit(False)
    for year, gp in races:
        wanted = wanted | ((F.col("Year") == year) & (F.col("GrandPrix") == gp))
    store_sketches(race_sketches(silver_laps.where(wanted)), root)


def read_sketches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(f"{root}/statistics")


def stored_files(spark: SparkSession, root: str) -> list[str]:
    return folders.listed(spark, f"{root}/statistics/*/*/*.parquet")

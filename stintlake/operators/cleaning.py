"""Silver cleaning: the fixed column list, types and row filters of the lake."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import schemas


def _projected(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def clean_laps(df: DataFrame) -> DataFrame:
    """Timed laps only; an unknown tyre life counts as 0."""
    timed = df.where(F.col("LapTime").isNotNull())
    return _projected(timed, schemas.SILVER_LAPS).fillna({"TyreLife": 0})


def clean_telemetry(df: DataFrame) -> DataFrame:
    """Moving samples inside a numbered lap; numeric gaps become 0 before the filter."""
    flags = df.withColumn("Brake", F.col("Brake").cast("boolean").cast("int"))
    filled = _projected(flags, schemas.SILVER_TELEMETRY).fillna(0)
    return filled.where((F.col("Speed") > 0) & (F.col("LapNumber") > 0))

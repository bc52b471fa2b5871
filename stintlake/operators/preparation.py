"""Bronze preparation: from timing-feed tables to typed lap, telemetry and message tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlake import constants as K
from stintlake.functions import asof, ordered
from stintlake.functions import columns as C

PIECE_S = 10.0
UNORDERED = {*K.LAP, "SessionTime", "Speed"}


def assemble_telemetry(samples: DataFrame, laps: DataFrame, bucket_seconds: float) -> DataFrame:
    """Gives each sample the lap it falls in: LapStart <= SessionTime < LapEnd.

    An interval join made an equi-join: a lap is listed once per time bucket it touches and a
    sample joins on (driver, bucket), so one long session of one driver is spread over many
    tasks and a sample only meets the laps of its own bucket. Laps without a number are left
    out; laps without samples and samples outside every lap do not appear.
    """
    width = F.lit(float(bucket_seconds))
    windows = laps.where(F.col("LapNumber").isNotNull()).select(
        *K.SESSION_DRIVER,
        "Team",
        F.col("LapNumber").cast("int").alias("LapNumber"),
        "Compound",
        "LapStart",
        "LapEnd",
        F.explode(
            F.sequence(
                F.floor(F.col("LapStart") / width), F.floor(F.col("LapEnd") / width)
            )
        ).alias("_bucket"),
    )
    return (
        samples.withColumn("_bucket", F.floor(F.col("SessionTime") / width))
        .join(windows, [*K.SESSION_DRIVER, "_bucket"])
        .where(
            (F.col("SessionTime") >= F.col("LapStart")) & (F.col("SessionTime") < F.col("LapEnd"))
        )
        .drop("_bucket", "LapStart", "LapEnd")
    )


def lap_distance(samples: DataFrame) -> DataFrame:
    """Adds `Distance`: metres driven since the lap began, integrated from speed and time.

    Samples of one instant are ordered by speed and then by their other columns: the step since
    the instant before counts with the lowest of their speeds, whatever the order of the rows."""
    order = ["SessionTime", "Speed", *[c for c in samples.columns if c not in UNORDERED]]
    placed = ordered.cut(samples, ordered.bucket("SessionTime", PIECE_S))
    timed = ordered.previous(placed, K.LAP, order, ["SessionTime"], "_before")
    step = F.col("SessionTime") - F.col("_before.SessionTime")
    metres = F.coalesce(F.col("Speed") / F.lit(3.6) * step, F.lit(0.0))
    return ordered.running_sum(timed, K.LAP, order, Distance=metres).drop(
        "_before", "_piece"
    )


def ensure_columns(df: DataFrame, names=K.TELEMETRY_COLUMNS) -> DataFrame:
    """Adds each missing channel as a constant 0."""
    missing = [name for name in names if name not in df.columns]
    return df.select("*", *[F.lit(0).alias(name) for name in missing])


def normalise_channels(df: DataFrame) -> DataFrame:
    """Narrows the channel types and fills the gaps; the distance ahead is kept in 0..9999."""

    def filled(name, kind):
        return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)

    ahead = C.clamp(F.coalesce(F.col("DistanceToDriverAhead"), F.lit(0)), 0, 9999)
    changed = {
        "Distance": F.col("Distance").cast("float"),
        "Speed": F.col("Speed").cast("float"),
        "RPM": filled("RPM", "smallint"),
        "nGear": filled("nGear", "tinyint"),
        "Throttle": filled("Throttle", "tinyint"),
        "Brake": F.coalesce(F.col("Brake").cast("boolean"), F.lit(False)),
        "DRS": filled("DRS", "tinyint"),
        "LapNumber": F.col("LapNumber").cast("smallint"),
        "X": filled("X", "int"),
        "Y": filled("Y", "int"),
        "SessionTime": filled("SessionTime", "float"),
        "DriverAhead": F.coalesce(F.col("DriverAhead").cast("string"), F.lit("")),
        "DistanceToDriverAhead": ahead.cast("float"),
    }
    return df.withColumns(changed)


def normalise_laps(df: DataFrame, year=None, grand_prix=None) -> DataFrame:
    """Durations to seconds, moments to text, dimensions to text, and the race columns."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DayTimeIntervalType):
            changed[field.name] = C.interval_seconds(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            changed[field.name] = F.col(field.name).cast("string")
        elif field.name in ("Driver", "Team", "Compound"):
            changed[field.name] = F.col(field.name).cast("string")
    if year is not None:
        changed["Year"] = F.lit(year)
    if grand_prix is not None:
        changed["GrandPrix"] = C.slug(F.lit(grand_prix))
    return df.withColumns(changed) if changed else df


def clean_events(df: DataFrame) -> DataFrame:
    """Race-control messages: text gaps become "", an unreadable lap becomes 0."""
    changed = {}
    if "Time" in df.columns:
        changed["Time"] = F.col("Time").cast("string")
    for name in K.EVENT_TEXT_COLUMNS:
        if name in df.columns:
            changed[name] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    if "Lap" in df.columns:
        lap = F.col("Lap").cast("string").try_cast("double").try_cast("smallint")
        changed["Lap"] = F.coalesce(lap, F.lit(0)).cast("smallint")
    return df.withColumns(changed)


def events_summary(df: DataFrame) -> DataFrame:
    """Messages and flag messages per race; without a category every message counts."""
    flags = F.col("Category") == "Flag" if "Category" in df.columns else F.lit(True)
    return df.groupBy(*K.RACE).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(flags).alias("flags")
    )


def race_status(rows: DataFrame, messages: DataFrame, at: str, width: float) -> DataFrame:
    """Adds to rows of a race the state that race control had called when they began: `race_status`
    (the flag, or SC for the safety car) and `status_since`. Messages that call no state don't count;
    before the first, both are null. Of states called at one instant, the greatest name counts."""
    flag = F.when(F.col("Category") == "SafetyCar", "SC").when(F.col("Flag") != "", F.col("Flag"))
    called = messages.select(*K.RACE, at, flag.alias("race_status")).where("race_status IS NOT NULL")
    joined = asof.last_before(rows, called, K.RACE, at, ["race_status"], width)
    return joined.withColumnRenamed("_since", "status_since")


def missing_drivers(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers in the results of a race who have no lap in it, one row each."""
    expected = results.where(F.col("Abbreviation").isNotNull()).select(
        *K.RACE, F.col("Abbreviation").cast("string").alias("Driver")
    )
    present = laps.select(*K.SESSION_DRIVER).distinct()
    return expected.distinct().join(present, K.SESSION_DRIVER, "left_anti")


def ingest_report(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Per race: how many drivers have laps, and the sorted list of those who have none."""
    present = (
        laps.select(*K.SESSION_DRIVER).distinct().groupBy(*K.RACE)
        .agg(F.count("Driver").alias("pilotos"))
    )
    missing = missing_drivers(results, laps).groupBy(*K.RACE).agg(
        F.array_sort(F.collect_list("Driver")).alias("faltantes")
    )
    return present.join(missing, K.RACE, "left").select(
        F.col("GrandPrix").alias("gp"),
        F.col("Year").cast("int").alias("year"),
        "pilotos",
        F.coalesce("faltantes", F.array().cast("array<string>")).alias("faltantes"),
    )


def raced(calendar: DataFrame, as_of) -> DataFrame:
    """The races held before `as_of` (a date)."""
    return calendar.where(F.col("EventDate") < F.lit(as_of))


def pending_races(calendar: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """The races still to ingest: those not written yet, or all of them with `overwrite`."""
    wanted = calendar.select("Year", C.slug("EventName").alias("GrandPrix")).distinct()
    if overwrite:
        return wanted
    return wanted.join(done.select(*K.RACE).distinct(), K.RACE, "left_anti")

"""Data quality: sampling density, stalled or jumping positions, coverage of the lake."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.functions import ordered
from stintlake.functions.groups import exact_quantiles
from stintlake.operators import laps as L

SPACING_BIN_M = 1.0
PIECE_M = 100.0


def sample_deltas(telemetry: DataFrame) -> DataFrame:
    """Per sample, against the one before it in its lap: metres driven (`arc`) and metres the
    position moved in a straight line (`chord`); null on the first sample."""
    slim = telemetry.select(*K.LAP, "Distance", "X", "Y")
    # A stalled car repeats one sample: equal samples are counted first, and all but the first of
    # them have not moved.
    equal = slim.groupBy(*K.LAP, "Distance", "X", "Y").agg(F.count(F.lit(1)).alias("_times"))
    placed = ordered.cut(equal, ordered.bucket("Distance", PIECE_M))
    columns = ["Distance", "X", "Y"]
    moved = ordered.previous(placed, K.LAP, columns, columns, "_before")
    dx = F.col("X") - F.col("_before.X")
    dy = F.col("Y") - F.col("_before.Y")
    arc = F.col("Distance") - F.col("_before.Distance")
    chord = F.sqrt(dx * dx + dy * dy) / F.lit(float(K.POSITION_UNITS_PER_METRE))
    step = F.struct(arc.alias("arc"), chord.alias("chord"))
    still = F.struct(
        (F.col("Distance") - F.col("Distance")).alias("arc"),
        ((F.col("X") - F.col("X") + F.col("Y") - F.col("Y")).cast("double")).alias("chord"),
    )
    steps = F.concat(F.array(step), F.array_repeat(still, (F.col("_times") - 1).cast("int")))
    return moved.select(*K.LAP, "Distance", F.inline(steps))


def lap_position_quality(telemetry: DataFrame) -> DataFrame:
    """Share of each lap's distance over which the position followed the car, 0 to 1."""
    arc, chord = F.col("arc"), F.col("chord")
    valid = arc > K.MIN_STEP_M
    stalled = valid & (chord < arc * K.STALLED_RATIO)
    sums = sample_deltas(telemetry).groupBy(*K.LAP).agg(
        F.count(F.lit(1)).alias("samples"),
        C.half_up(F.sum(F.when(valid, arc)), 6).alias("_driven"),
        C.half_up(F.coalesce(F.sum(F.when(stalled, arc)), F.lit(0.0)), 6).alias("_lost"),
    )
    share = C.half_up(F.lit(1.0) - F.col("_lost") / F.col("_driven"), 3)
    enough = (F.col("samples") >= K.MIN_QUALITY_SAMPLES) & F.col("_driven").isNotNull()
    return sums.select(
        *K.LAP, "samples", F.when(enough, share).otherwise(F.lit(0.0)).alias("quality")
    )


def race_position_quality(telemetry: DataFrame) -> DataFrame:
    """Quality of a race, judged on the middle lap of its first driver by code."""
    laps = telemetry.select(*K.LAP).distinct()
    drivers = laps.groupBy(*K.RACE).agg(F.min("Driver").alias("Driver"))
    first = laps.join(drivers, K.SESSION_DRIVER, "left_semi")
    middle = L.middle_of(first, K.SESSION_DRIVER)
    chosen = telemetry.join(middle, K.LAP, "left_semi")
    return lap_position_quality(chosen).select(
        *K.LAP, "quality", (F.col("quality") >= K.POSITION_OK).alias("position_ok")
    )


def incoherent_samples(telemetry: DataFrame) -> DataFrame:
    """Samples per lap whose position moved further than the car can have driven."""
    arc, chord = F.col("arc"), F.col("chord")
    jump = (arc > K.MIN_STEP_M) & (chord > arc * K.JUMP_RATIO)
    return sample_deltas(telemetry).groupBy(*K.LAP).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(jump).alias("incoherent")
    )


def sample_spacing(telemetry: DataFrame) -> DataFrame:
    """Median, smallest and largest step between the samples of each lap, in metres."""
    steps = sample_deltas(telemetry).where(F.col("arc").isNotNull())
    extremes = steps.groupBy(*K.LAP).agg(
        F.min("arc").alias("min_step"), F.max("arc").alias("max_step")
    )
    medians = exact_quantiles(steps, K.LAP, "arc", {"median_step": 0.5}, SPACING_BIN_M)
    return extremes.join(medians, K.LAP)


def sampling_density(telemetry: DataFrame, by: list[str] = ()) -> DataFrame:
    """Samples per lap: median, smallest and largest, over the lake or per group in `by`."""
    laps = telemetry.groupBy(*K.LAP).agg(F.count(F.lit(1)).alias("samples"))
    sizes = laps.groupBy(*by, "samples").agg(F.count(F.lit(1)).alias("_laps"))
    return sizes.groupBy(*by).agg(
        F.percentile("samples", 0.5, F.col("_laps")).alias("median_samples"),
        F.min("samples").alias("min_samples"),
        F.max("samples").alias("max_samples"),
    )


def position_presence(telemetry: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether both coordinates carry data, and their range."""
    return telemetry.groupBy(*by).agg(
        ((F.max(F.abs("X")) > 0) & (F.max(F.abs("Y")) > 0)).alias("has_position"),
        F.min("X").alias("min_x"),
        F.max("X").alias("max_x"),
        F.min("Y").alias("min_y"),
        F.max("Y").alias("max_y"),
    )


def distance_reset(telemetry: DataFrame) -> DataFrame:
    """Distance range of each driver's first lap: it must be one lap, not the whole race."""
    laps = telemetry.groupBy(*K.LAP).agg(
        F.min("Distance").alias("min_distance"), F.max("Distance").alias("max_distance")
    )
    first = F.min(F.struct("LapNumber", "min_distance", "max_distance")).alias("_first")
    return laps.groupBy(*K.SESSION_DRIVER).agg(first).select(*K.SESSION_DRIVER, "_first.*")


def lake_profile(telemetry: DataFrame) -> DataFrame:
    """Rows, races, drivers and lap range of a lake table."""
    parts = telemetry.groupBy(*K.SESSION_DRIVER).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("LapNumber").alias("_first"),
        F.max("LapNumber").alias("_last"),
    )
    return parts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count_distinct("Year", "GrandPrix").alias("races"),
        F.count_distinct("Driver").alias("drivers"),
        F.min("_first").alias("first_lap"),
        F.max("_last").alias("last_lap"),
    )


def partition_files(df: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes behind each partition of a table read from files."""
    files = df.select(
        *by,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
    ).distinct()
    return files.groupBy(*by).agg(
        F.count("file").alias("files"), F.sum("bytes").alias("bytes")
    )


def telemetry_drivers(telemetry: DataFrame) -> DataFrame:
    """Drivers with telemetry, per race: the roster to offer."""
    return telemetry.select(*K.SESSION_DRIVER).distinct()


def telemetry_only_drivers(telemetry: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers with telemetry but without a timed lap (they retired early)."""
    timed = laps.where(F.col("LapTime").isNotNull()).select(*K.SESSION_DRIVER).distinct()
    return telemetry_drivers(telemetry).join(timed, K.SESSION_DRIVER, "left_anti")


def missing_position(telemetry: DataFrame) -> DataFrame:
    """Samples without a position and all samples, per driver and race."""
    lost = (F.col("X") == 0) & (F.col("Y") == 0)
    return telemetry.groupBy(*K.SESSION_DRIVER).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(lost).alias("dropped")
    )

"""Lap serving: which laps exist, which one to show, and its points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.functions import ordered
from stintlake.functions.groups import exact_ranks, number_rows

LAPS_PER_BUCKET = 256.0
PIECE_M = 100.0


def drop_missing_position(telemetry: DataFrame) -> DataFrame:
    """Leaves out the samples at (0, 0): positions the feed did not deliver."""
    return telemetry.where((F.col("X") != 0) | (F.col("Y") != 0))


def laps_available(telemetry: DataFrame) -> DataFrame:
    """The laps of each driver and race that have positioned samples, numbered from 0."""
    laps = drop_missing_position(telemetry).select(*K.LAP).distinct()
    laps = laps.withColumn("_bucket", F.floor(F.col("LapNumber") / LAPS_PER_BUCKET))
    numbered = number_rows(laps, K.SESSION_DRIVER, "_bucket", ["LapNumber"], "_place")
    return numbered.select(*K.LAP, (F.col("_place") - 1).alias("place"))


def middle_of(laps: DataFrame, by: list[str]) -> DataFrame:
    """The middle lap number of each group of distinct laps: place floor(n / 2) from 0."""
    return exact_ranks(
        laps, by, "LapNumber", {"_middle": lambda n: F.floor(n / 2)}, LAPS_PER_BUCKET
    ).select(*by, F.col("_middle").alias("LapNumber"))


def middle_lap(telemetry: DataFrame) -> DataFrame:
    """The representative lap of each driver and race: the middle one of those available."""
    laps = drop_missing_position(telemetry).select(*K.LAP).distinct()
    return middle_of(laps, K.SESSION_DRIVER)


def select_lap(telemetry: DataFrame, lap: int | None = None) -> DataFrame:
    """Positioned samples of one lap per driver and race: `lap`, or the middle one."""
    placed = drop_missing_position(telemetry)
    if lap is not None:
        return placed.where(F.col("LapNumber") == lap)
    return placed.join(middle_lap(telemetry), K.LAP, "left_semi")


def unknown_lap(telemetry: DataFrame, lap: int) -> DataFrame:
    """For each driver and race without `lap`: the laps that could be asked for instead."""
    available = laps_available(telemetry)
    known = available.where(F.col("LapNumber") == lap).select(*K.SESSION_DRIVER)
    return available.join(known, K.SESSION_DRIVER, "left_anti").select(*K.LAP)


def lap_points(telemetry: DataFrame) -> DataFrame:
    """Points as served: rounded channels, gaps as 0. Sort by lap and distance to draw them."""

    def one_decimal(name):
        return C.half_up(C.finite_or_zero(F.col(name)), 1)

    def integer(name):
        return C.whole(C.finite_or_zero(F.col(name).cast("double")))

    return telemetry.select(
        *K.LAP,
        F.coalesce(F.col("Compound"), F.lit("")).alias("compound")
        if "Compound" in telemetry.columns
        else F.lit("").alias("compound"),
        one_decimal("Distance").alias("distance"),
        one_decimal("Speed").alias("speed"),
        integer("RPM").alias("rpm"),
        F.col("nGear").cast("int").alias("gear"),
        integer("Throttle").alias("throttle"),
        (F.coalesce(F.col("Brake").cast("int"), F.lit(0)) != 0).cast("int").alias("brake"),
        F.col("DRS").cast("int").alias("drs"),
        integer("X").alias("x"),
        integer("Y").alias("y"),
    )


def lap_bounds(telemetry: DataFrame) -> DataFrame:
    """Extent of the positions and number of points of each lap."""
    return drop_missing_position(telemetry).groupBy(*K.LAP).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("X").alias("min_x"),
        F.max("X").alias("max_x"),
        F.min("Y").alias("min_y"),
        F.max("Y").alias("max_y"),
    )


def fastest_laps(laps: DataFrame) -> DataFrame:
    """Fastest timed lap of each driver and race; equal times: the earlier lap."""
    best = F.min(F.struct("LapTime", "LapNumber"))
    return (
        laps.where(F.col("LapTime").isNotNull())
        .groupBy(*K.SESSION_DRIVER)
        .agg(best.alias("_best"))
        .select(*K.SESSION_DRIVER, "_best.LapNumber", "_best.LapTime")
    )


def fastest_lap(laps: DataFrame, telemetry: DataFrame) -> DataFrame:
    """The samples of each driver's fastest lap, with its time."""
    return telemetry.join(fastest_laps(laps), K.LAP)


def head_to_head(laps: DataFrame, telemetry: DataFrame, first: str, second: str) -> DataFrame:
    """Speed, throttle and brake along the distance, for the fastest laps of two drivers."""
    pair = F.col("Driver").isin(first, second)
    chosen = fastest_lap(laps.where(pair), telemetry.where(pair))
    return chosen.select(
        *K.LAP, "Distance", "Speed", "Throttle", F.col("Brake").cast("int").alias("Brake")
    )


def on_grid(samples: DataFrame, step: float) -> DataFrame:
    """The samples of each lap resampled every `step` metres: speed and throttle in between the
    samples on either side, the brake as it last was. No points before the first or behind the
    last sample; of samples at one distance the least (speed, throttle, brake) counts."""
    one = samples.where(F.col("Distance").isNotNull()).groupBy(*K.LAP, "Distance").agg(
        F.min(F.struct("Speed", "Throttle", F.col("Brake").cast("int").alias("Brake"))).alias("_at")
    )
    placed = ordered.cut(one, ordered.bucket("Distance", PIECE_M))
    follow = ordered.previous(placed, K.LAP, ["Distance"], ["Distance", "_at"], "_from")
    here = F.col("Distance")
    first = F.when(F.col("_from").isNull(), F.ceil(here / step)).otherwise(
        F.floor(F.col("_from.Distance") / step) + 1
    )
    last = F.floor(here / step)
    points = F.when(first <= last, F.sequence(first, last))
    metres = F.col("point") * F.lit(step)
    share = (metres - F.col("_from.Distance")) / (here - F.col("_from.Distance"))

    def between(name):
        low, high = F.col(f"_from._at.{name}"), F.col(f"_at.{name}")
        return F.when(metres == here, high).otherwise(low + (high - low) * share).alias(name)

    brake = F.when(metres == here, F.col("_at.Brake")).otherwise(F.col("_from._at.Brake"))
    return follow.withColumn("point", F.explode(points)).select(
        *K.LAP, "point", metres.alias("Distance"), between("Speed"), between("Throttle"),
        brake.alias("Brake"),
    )


def head_to_head_aligned(
    laps: DataFrame, telemetry: DataFrame, first: str, second: str, step: float = 10.0
) -> DataFrame:
    """The fastest laps of two drivers side by side, every `step` metres: what either did there
    and how much faster the first was. Where only one of the laps has points, the other is null."""
    pair = F.col("Driver").isin(first, second)
    chosen = fastest_lap(laps.where(pair), telemetry.where(pair)).select(
        *K.LAP, "Distance", "Speed", "Throttle", "Brake"
    )
    grid = on_grid(chosen, step)

    def side(driver, suffix):
        return grid.where(F.col("Driver") == driver).select(
            *K.RACE, "point",
            *[F.col(c).alias(f"{c.lower()}_{suffix}") for c in ("LapNumber", "Speed", "Throttle", "Brake")],
        )

    both = side(first, "a").join(side(second, "b"), [*K.RACE, "point"], "full")
    return both.select(
        *K.RACE, (F.col("point") * F.lit(step)).alias("Distance"),
        *[f"{c}_{suffix}" for suffix in "ab" for c in ("lapnumber", "speed", "throttle", "brake")],
        (F.col("speed_a") - F.col("speed_b")).alias("speed_gap"),
    )


def lap_progress(points: DataFrame) -> DataFrame:
    """Progress of each point of a lap in percent, by index and as a share of the distance."""
    placed = ordered.cut(points, ordered.bucket("distance", PIECE_M))
    numbered = ordered.running_sum(placed, K.LAP, ["distance", "x", "y"], _place=F.lit(1))
    measured = ordered.group_values(
        numbered,
        K.LAP,
        _points=F.count(F.lit(1)),
        _start=F.min("distance"),
        _end=F.max("distance"),
    )
    last = F.col("_points") - 1
    span = F.col("_end") - F.col("_start")
    return measured.withColumns(
        {
            "progress_pct": F.when(
                last > 0, (F.col("_place") - 1) / last * F.lit(100.0)
            ).otherwise(F.lit(0.0)),
            "distance_ratio": F.when(span == 0, F.lit(0.0)).otherwise(
                (F.col("distance") - F.col("_start")) / span
            ),
        }
    ).drop("_piece", "_place", "_points", "_start", "_end")

"""Pace and tyre wear: comparable laps, fuel correction, and the tables for the dashboards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C

# The columns of the warehouse table.
WAREHOUSE_LAP_COLUMNS = [
    "Year", "Temporada", "GrandPrix", "Circuito", "Driver", "Team",
    "LapNumber", "Stint", "Compound", "TyreLife", "EsLluvia",
    "LapTime", "LapTimeFuelAdj", "DeltaRitmo",
    "Sector1Time", "Sector2Time", "Sector3Time",
]


#: What the dashboards filter by, and the axes of their curves.
BI_FILTERS = ["Compound", "Temporada", "Circuito"]
BI_AXES = ["LapNumber", "TyreLife"]


def rule_107(laps: DataFrame, by: list[str]) -> DataFrame:
    """Keeps the laps within 107% of the median lap time of their group.

    Lap times come in whole milliseconds, so a group has some 100,000 different ones at most:
    they are counted first, and the median is taken from the counts. A group is a circuit or a race,
    so the medians are broadcast and no lap moves."""
    times = laps.groupBy(*by, "LapTime").agg(F.count(F.lit(1)).alias("_laps"))
    medians = times.groupBy(*by).agg(F.percentile("LapTime", 0.5, F.col("_laps")).alias("_median"))
    return (
        laps.join(F.broadcast(medians), by)
        .where(F.col("LapTime") <= F.col("_median") * F.lit(K.PACE_LIMIT))
        .drop("_median")
    )


def dry_only(laps: DataFrame) -> DataFrame:
    return laps.where(C.is_dry())


def pace_delta(laps: DataFrame, by: list[str], name: str = K.MODEL_TARGET) -> DataFrame:
    """Adds `LapTimeFuelAdj` and `name`, its distance to the driver's best in the group.

    The fuel term is FUEL * (longest lap number of the group - lap number). Within a group it
    shifts all laps by the same constant, so the best adjusted lap of a driver is known
    before that constant is, and one aggregate gives both.
    """
    fuel = F.lit(K.FUEL_SECONDS_PER_LAP)
    drivers = laps.groupBy(*by, "Driver").agg(
        F.min(
            F.struct(
                (F.col("LapTime") + fuel * F.col("LapNumber")).alias("rank"),
                F.col("LapTime").alias("time"),
                F.col("LapNumber").alias("lap"),
            )
        ).alias("_best"),
        F.max("LapNumber").alias("_longest"),
    )
    # The longest lap of a group from its drivers' ones: a window over a row per driver.
    total = F.max("_longest").over(Window.partitionBy(*by))
    reference = drivers.withColumn("_total", total).select(
        *by,
        "Driver",
        "_total",
        (F.col("_best.time") - fuel * (F.col("_total") - F.col("_best.lap"))).alias("_reference"),
    )
    adjusted = F.col("LapTime") - fuel * (F.col("_total") - F.col("LapNumber"))
    return (
        laps.join(reference, [*by, "Driver"])
        .withColumn("LapTimeFuelAdj", adjusted)
        .withColumn(name, F.col("LapTimeFuelAdj") - F.col("_reference"))
        .drop("_total", "_reference")
    )


def fuel_adjust(laps: DataFrame, by: list[str]) -> DataFrame:
    """Adds the lap time without the weight of the fuel still on board."""
    totals = laps.groupBy(*by).agg(F.max("LapNumber").alias("_total"))
    fuel = F.lit(K.FUEL_SECONDS_PER_LAP)
    return (
        laps.join(F.broadcast(totals), by)
        .withColumn(
            "LapTimeFuelAdj", F.col("LapTime") - fuel * (F.col("_total") - F.col("LapNumber"))
        )
        .drop("_total")
    )


def wet_flag(compat: bool = False):
    """Whether a lap was on rain tyres; an unknown compound counts as wet with `compat`."""
    return ~F.coalesce(C.is_dry(), F.lit(False) if compat else F.lit(True))


def race_names(races: DataFrame) -> DataFrame:
    """Adds the readable name of each race slug."""
    return races.withColumn("nombre", C.display_name("GrandPrix"))


def warehouse_laps(laps: DataFrame, names: DataFrame, compat: bool = False) -> DataFrame:
    """The lap table of the warehouse: comparable laps with pace, names, season and rain flag.

    `names` holds (slug, nombre), one row per slug; a race without a name keeps its slug.
    """
    timed = laps.where(F.col("LapTime").isNotNull())
    paced = pace_delta(rule_107(timed, K.RACE), K.RACE, "DeltaRitmo")
    named = paced.join(
        F.broadcast(names.select(F.col("slug").alias("GrandPrix"), F.col("nombre").alias("_name"))),
        "GrandPrix",
        "left",
    )
    return named.withColumns(
        {
            "DeltaRitmo": C.half_up("DeltaRitmo", 3),
            "Circuito": F.coalesce("_name", "GrandPrix"),
            "Temporada": F.col("Year").cast("string"),
            "EsLluvia": wet_flag(compat),
        }
    ).select(*WAREHOUSE_LAP_COLUMNS)


def warehouse_predictions(predictions: DataFrame, names: DataFrame) -> DataFrame:
    """The prediction table of the warehouse, with the signed difference to the real stop."""
    named = predictions.join(
        names.select(F.col("slug").alias("gp"), F.col("nombre").alias("_name")), "gp", "left"
    )
    return named.select(
        *predictions.columns,
        F.coalesce("_name", "gp").alias("Circuito"),
        F.col("year").cast("string").alias("Temporada"),
        (F.col("pit_window") - F.col("pit_real")).alias("DiferenciaVueltas"),
    )


def warehouse_summary(laps: DataFrame) -> DataFrame:
    """Rows, seasons and circuits of a loaded lap table."""
    races = laps.groupBy(*K.RACE).agg(F.count(F.lit(1)).alias("_rows"))
    return races.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count_distinct("Year").alias("seasons"),
        F.count_distinct("GrandPrix").alias("circuits"),
    )


def _filtered(df: DataFrame, filters: dict) -> DataFrame:
    for name, wanted in filters.items():
        values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        df = df.where(F.col(name).isin(*values))
    return df


def bi_lap_curve(laps: DataFrame, **filters) -> DataFrame:
    """Mean absolute lap time by lap number; filters are column=value or column=[values]."""
    return _filtered(laps, filters).groupBy("LapNumber").agg(
        F.avg("LapTime").alias("mean_lap_time"), F.count(F.lit(1)).alias("laps")
    )


def bi_wear_curve(laps: DataFrame, **filters) -> DataFrame:
    """Mean pace delta by tyre life; filters as in `bi_lap_curve`."""
    return _filtered(laps, filters).groupBy("TyreLife").agg(
        F.avg("DeltaRitmo").alias("mean_delta"), F.count(F.lit(1)).alias("laps")
    )


def bi_partials(laps: DataFrame) -> DataFrame:
    """What all dashboard curves are sums of: a row for every combination of the filters, lap number
    and tyre life, with sums in whole milliseconds, which merge in any order."""
    return laps.groupBy(*BI_FILTERS, *BI_AXES).agg(
        F.count(F.lit(1)).alias("laps"),
        F.count("LapTime").alias("timed"), F.sum(F.round(F.col("LapTime") * 1000).cast("long")).alias("time_ms"),
        F.count("DeltaRitmo").alias("paced"), F.sum(F.round(F.col("DeltaRitmo") * 1000).cast("long")).alias("delta_ms"),
    )


def bi_cube(partials: DataFrame) -> DataFrame:
    """The curves for every choice of filters at once, from the partials: a row per axis, its value
    and grouping set. `all_<filter>` is 1 where that filter is left open."""
    axes = F.explode(
        F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("value")) for a in BI_AXES])
    )
    placed = partials.select("*", axes.alias("_axis")).select("*", "_axis.*")
    on = ["axis", "value"]
    sets = [
        [*on, *[name for k, name in enumerate(BI_FILTERS) if chosen >> k & 1]]
        for chosen in range(1 << len(BI_FILTERS))
    ]
    return placed.groupingSets(sets, *on, *BI_FILTERS).agg(
        *[F.grouping(name).cast("int").alias(f"all_{name}") for name in BI_FILTERS],
        *[F.sum(name).alias(name) for name in ("laps", "timed", "time_ms", "paced", "delta_ms")],
    )


def bi_answer(cube: DataFrame, axis: str, **filters) -> DataFrame:
    """A curve out of the stored cube: mean lap time and mean pace delta along an axis, for filters
    as in `bi_lap_curve`. Several values of a filter add up their sums."""
    rows = cube.where(F.col("axis") == axis)
    for name in BI_FILTERS:
        rows = rows.where(F.col(f"all_{name}") == (0 if name in filters else 1))
    summed = _filtered(rows, filters).groupBy(F.col("value").cast("int").alias(axis)).agg(
        *[F.sum(name).alias(name) for name in ("laps", "timed", "time_ms", "paced", "delta_ms")]
    )
    return summed.select(
        axis, "laps",
        (F.col("time_ms") / F.nullif(F.col("timed"), F.lit(0)) / F.lit(1000.0)).alias("mean_lap_time"),
        (F.col("delta_ms") / F.nullif(F.col("paced"), F.lit(0)) / F.lit(1000.0)).alias("mean_delta"),
    )


def bi_stop_error(predictions: DataFrame) -> DataFrame:
    """Mean absolute and mean signed stop error by circuit, and over all (`total` 1)."""
    both = predictions.where(F.col("pit_window").isNotNull() & F.col("pit_real").isNotNull())
    difference = F.col("pit_window") - F.col("pit_real")
    return both.rollup("gp").agg(
        F.count(F.lit(1)).alias("stops"),
        F.avg(F.abs(difference)).alias("mean_error"),
        F.avg(difference).alias("mean_bias"),
        F.grouping("gp").cast("int").alias("total"),
    )


def wear_points(laps: DataFrame, low: float = 85, high: float = 105) -> DataFrame:
    """(TyreLife, LapTime, Compound) of dry laps inside a fixed pace window."""
    inside = (F.col("LapTime") > low) & (F.col("LapTime") < high)
    return dry_only(laps).where(inside).select("TyreLife", "LapTime", "Compound")

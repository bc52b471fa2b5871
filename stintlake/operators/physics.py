"""Forces derived from position, speed and distance, for every lap at once.

All functions take points as `laps.lap_points` serves them; distances are compared as whole
decimetres. Windows are keyed by pieces of laps (see `functions.ordered`).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.functions import ordered
from stintlake.functions.groups import exact_quantiles

G_BIN = 0.05

POINT = ["x", "y", "speed"]


def _point():
    return F.struct(F.col("_dm").alias("dm"), *POINT)


def located(points: DataFrame, base_m: int = K.NEIGHBOUR_BASE_M) -> DataFrame:
    """Adds `_dm`, `_place` (from 1), and the structs `before` and `after`, see `neighbours`.

    Points of one decimetre share their neighbours, so these are found among the decimetres of a
    lap, of which there are as many as the lap is long, not as it has points, and joined back.
    """
    base = base_m * 10
    placed = points.withColumn("_dm", F.round(F.col("distance") * 10).cast("long"))
    merged = placed.groupBy(*K.LAP, "_dm").agg(
        F.min(_point()).alias("_low"), F.max(_point()).alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    lap = Window.partitionBy(*K.LAP)
    rising = lap.orderBy("_dm")
    # The frames grow from one side only, so they are maintained incrementally.
    behind = rising.rangeBetween(Window.unboundedPreceding, -base)
    ahead = lap.orderBy(F.desc("_dm")).rangeBetween(Window.unboundedPreceding, -base)
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    found = merged.select(
        *K.LAP,
        "_dm",
        F.max("_high").over(behind).alias("_before"),
        F.min("_low").over(ahead).alias("_after"),
        F.min("_low").over(lap).alias("_first"),
        F.max("_high").over(lap).alias("_last"),
        F.sum("_n").over(lap).alias("_points"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"),
    )
    within = Window.partitionBy(*K.LAP, "_dm").orderBy(*POINT)
    numbered = placed.withColumn("_in", F.row_number().over(within))
    inner = (F.col("_place") > 1) & (F.col("_place") < F.col("_points"))
    return (
        ordered.joined(numbered, found, [*K.LAP, "_dm"])
        .withColumn("_place", F.col("_from") + F.col("_in"))
        .withColumn("before", F.when(inner, F.coalesce("_before", "_first")))
        .withColumn("after", F.when(inner, F.coalesce("_after", "_last")))
        .drop("_points", "_first", "_last", "_before", "_after", "_from", "_in")
    )


def neighbours(points: DataFrame, base_m: int = K.NEIGHBOUR_BASE_M) -> DataFrame:
    """Adds to each inner point of a lap the nearest points at least `base_m` away.

    `before` and `after` are structs (dm, x, y, speed); near a lap end, where no point is far
    enough, they are the first or last point of the lap. Both are null on the end points.
    """
    return located(points, base_m).drop("_dm", "_place")


def _curvature(points: DataFrame) -> DataFrame:
    """Adds the half span `_ds`, the ungated curvature `_bend` and the gate `_coherent`."""
    before, after = F.col("before"), F.col("after")
    dx_in, dy_in = F.col("x") - before["x"], F.col("y") - before["y"]
    dx_out, dy_out = after["x"] - F.col("x"), after["y"] - F.col("y")
    arc_in = (F.col("_dm") - before["dm"]) / F.lit(10.0)
    arc_out = (after["dm"] - F.col("_dm")) / F.lit(10.0)
    units = F.lit(float(K.POSITION_UNITS_PER_METRE))
    chord_in = F.sqrt(dx_in * dx_in + dy_in * dy_in) / units
    chord_out = F.sqrt(dx_out * dx_out + dy_out * dy_out) / units
    ratio = F.lit(K.COHERENCE_RATIO)
    turn = F.abs(C.angle_difference(F.atan2(dy_out, dx_out), F.atan2(dy_in, dx_in)))
    span = (after["dm"] - before["dm"]) / F.lit(20.0)
    return located(points).withColumns(
        {
            "_ds": span,
            "_bend": F.when(span > 1, turn / span),
            "_coherent": (arc_in > 1)
            & (arc_out > 1)
            & (chord_in <= arc_in * ratio)
            & (chord_out <= arc_out * ratio),
        }
    )


def _lateral(bend):
    v = F.col("speed") / F.lit(3.6)
    return v * v * bend / F.lit(K.GRAVITY)


def _forces(points: DataFrame) -> DataFrame:
    v = F.col("speed") / F.lit(3.6)
    length = (F.col("after.dm") - F.col("before.dm")) / F.lit(10.0)
    dv = (F.col("after.speed") - F.col("before.speed")) / F.lit(3.6)
    usable = F.col("_coherent") & (F.col("_ds") > 1)
    return (
        _curvature(points)
        .withColumns(
            {
                "g_lat": F.when(usable, _lateral(F.col("_bend"))).otherwise(F.lit(0.0)),
                "g_lon": F.when(length > 1, v * (dv / length) / F.lit(K.GRAVITY)).otherwise(
                    F.lit(0.0)
                ),
            }
        )
        .drop("_ds", "_bend", "_coherent", "before", "after", "_dm")
    )


def raw_forces(points: DataFrame) -> DataFrame:
    """Adds the unsmoothed forces `g_lat` (gated by coherence) and `g_lon` (not gated)."""
    return _forces(points).drop("_place")


def lateral_g(points: DataFrame) -> DataFrame:
    return raw_forces(points).drop("g_lon")


def longitudinal_g(points: DataFrame) -> DataFrame:
    return raw_forces(points).drop("g_lat")


def upper_middle(values):
    """Middle of an array by size; of an even number of values the upper middle."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def smoothed_forces(points: DataFrame) -> DataFrame:
    """Moving median of the forces; where a lap end leaves an even number of points, the upper
    middle counts."""
    near = ordered.around(
        _forces(points),
        K.LAP,
        "_place",
        K.SMOOTHING_HALF_WIDTH,
        _lat=F.collect_list("g_lat"),
        _lon=F.collect_list("g_lon"),
    )
    return near.withColumns({"g_lat": upper_middle("_lat"), "g_lon": upper_middle("_lon")}).drop(
        "_lat", "_lon", "_place"
    )


def enrich(points: DataFrame) -> DataFrame:
    """Adds smoothed, clamped forces with two decimals; laps of under 3 points get 0."""
    return smoothed_forces(points).withColumns(
        {
            "g_lat": C.half_up(C.clamp("g_lat", 0.0, K.LATERAL_MAX_G), 2),
            "g_lon": C.half_up(C.clamp("g_lon", K.LONGITUDINAL_MIN_G, K.LONGITUDINAL_MAX_G), 2),
        }
    )


def _checked(points: DataFrame) -> DataFrame:
    usable = _curvature(points).where(F.col("_ds") > 1)
    gated = F.when(F.col("_coherent"), F.col("_bend"))
    forces = usable.withColumns(
        {
            "g_raw": _lateral(F.col("_bend")),
            "_gated": F.coalesce(_lateral(gated), F.lit(0.0)),
            "radius_m": F.when(gated > 1e-6, F.lit(1.0) / gated).otherwise(
                F.lit(float("inf"))
            ),
        }
    ).drop("x", "y", "before", "after", "_dm", "_ds", "_bend", "_coherent")
    # Unusable points left holes in the numbering.
    placed = ordered.cut(forces, ordered.bucket("_place", ordered.STRETCH))
    renumbered = ordered.running_sum(placed, K.LAP, ["_place"], _rank=F.lit(1))
    return ordered.around(
        renumbered, K.LAP, "_rank", K.SMOOTHING_HALF_WIDTH, g=F.percentile("_gated", 0.5)
    ).drop("_gated")


def diagnostic_points(points: DataFrame) -> DataFrame:
    """Points with a usable span: lateral force without gate (`g_raw`), with gate and ordinary
    moving median (`g`), and the radius of the bend in m (infinite when straight or gated)."""
    return _checked(points).select(*K.LAP, "distance", "speed", "g_raw", "g", "radius_m")


def _percentiles(checked: DataFrame) -> DataFrame:
    """Percentiles of laps, ranked in bins: an aggregate would hold a whole lap in memory."""
    both = F.array(
        F.struct(F.lit("g").alias("of"), F.col("g").alias("value")),
        F.struct(F.lit("g_raw").alias("of"), F.col("g_raw").alias("value")),
    )
    long = checked.select(*K.LAP, F.inline(both))
    ranked = exact_quantiles(long, [*K.LAP, "of"], "value", {"p50": 0.5, "p90": 0.9}, G_BIN)

    def pick(of, name):
        return F.max(F.when(F.col("of") == of, F.col(name)))

    return ranked.groupBy(*K.LAP).agg(
        pick("g", "p50").alias("median_g"),
        pick("g", "p90").alias("p90_g"),
        pick("g_raw", "p90").alias("p90_raw"),
    )


def g_diagnostic(points: DataFrame) -> DataFrame:
    """Per lap: spread of the lateral force with and without gate, and how it looks at the
    fastest and the slowest point."""
    place, shown = F.col("_place"), F.struct("speed", "g", "radius_m")
    measures = [
        F.count(F.lit(1)).alias("points"),
        F.max("g_raw").alias("max_raw"),
        F.max("g").alias("max_g"),
        F.max_by(shown, F.struct("speed", -place)).alias("fastest"),
        F.min_by(shown, F.struct("speed", place)).alias("slowest"),
    ]
    checked = _checked(points)
    found = ordered.joined(checked.groupBy(*K.LAP).agg(*measures), _percentiles(checked), K.LAP)
    return found.select(
        *K.LAP, "points", "p90_raw", "max_raw", "median_g", "p90_g", "max_g",
        *[
            F.col(f"{name}.{field}").alias(f"{name}_{field}")
            for name in ("fastest", "slowest")
            for field in ("speed", "g", "radius_m")
        ],
    )


def g_top(points: DataFrame, n: int = 5) -> DataFrame:
    """The `n` points of each lap with the highest lateral force; ties: the earlier point."""
    order = [F.desc("g"), "_place"]
    checked = _checked(points)

    def best(rows, window):
        ranked = rows.withColumn("rank", F.row_number().over(window.orderBy(*order)))
        return ranked.where(F.col("rank") <= n)

    top = best(best(checked, ordered.inside(K.LAP)), Window.partitionBy(*K.LAP))
    return top.select(*K.LAP, "rank", "distance", "speed", "g", "radius_m")


def gauges(enriched: DataFrame) -> DataFrame:
    """Instrument readings of each enriched point."""
    revs = C.clamp(
        (F.col("rpm") - K.RPM_MIN) / F.lit(float(K.RPM_MAX - K.RPM_MIN)), 0.0, 1.0
    )
    wheel = F.lit(3.6) * F.pi() * F.lit(K.WHEEL_DIAMETER_M)
    load = F.col("speed") / F.lit(float(K.AERO_REFERENCE_KMH))
    return enriched.withColumns(
        {
            "deceleration_g": F.abs(F.least(F.col("g_lon"), F.lit(0.0))),
            "high_load": F.col("g_lat") > K.HIGH_LOAD_G,
            "drs_open": F.col("drs") >= K.DRS_OPEN_FROM,
            "rev_ratio": revs,
            "lit_lights": C.whole(revs * K.SHIFT_LIGHTS),
            "wheel_turns_s": F.col("speed") / wheel,
            "aero_load_pct": load * load * F.lit(100.0),
        }
    )

"""Track geometry: the lap drawn in a fixed box, signal-loss cuts, braking zones, picking."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import ordered


ORDER = ["distance", "x", "y"]
PIECE_M = 100.0


def project_track(points: DataFrame) -> DataFrame:
    """Adds the place of each point in the map box, and the map units per metre of the lap.

    The lap is drawn upright or turned by 90 degrees, whichever comes out larger.
    """
    return _projected(points)


def _projected(points: DataFrame) -> DataFrame:
    inner_w = F.lit(float(K.MAP_WIDTH - 2 * K.MAP_PADDING))
    inner_h = F.lit(float(K.MAP_HEIGHT - 2 * K.MAP_PADDING))

    def span(name):
        width = F.col(f"_max_{name}") - F.col(f"_min_{name}")
        return F.when(width == 0, F.lit(1)).otherwise(width)

    extent = ordered.group_values(
        points,
        K.LAP,
        _min_x=F.min("x"),
        _max_x=F.max("x"),
        _min_y=F.min("y"),
        _max_y=F.max("y"),
    )
    measured = extent.withColumns({"_span_x": span("x"), "_span_y": span("y")}).withColumns(
        {
            "_upright": F.least(inner_w / F.col("_span_x"), inner_h / F.col("_span_y")),
            "_turned": F.least(inner_w / F.col("_span_y"), inner_h / F.col("_span_x")),
        }
    )
    upright = F.col("_upright") >= F.col("_turned")

    def either(first, second):
        return F.when(upright, first).otherwise(second)

    scale = F.col("_scale")
    return (
        measured.withColumns(
            {
                "_scale": F.greatest("_upright", "_turned"),
                "_right": either(F.col("x") - F.col("_min_x"), F.col("y") - F.col("_min_y")),
                "_up": either(F.col("y") - F.col("_min_y"), F.col("_max_x") - F.col("x")),
                "_wide": either(F.col("_span_x"), F.col("_span_y")),
                "_high": either(F.col("_span_y"), F.col("_span_x")),
            }
        )
        .withColumns(
            {
                "map_x": (F.lit(K.MAP_WIDTH) - F.col("_wide") * scale) / F.lit(2.0)
                + F.col("_right") * scale,
                "map_y": F.lit(K.MAP_HEIGHT)
                - ((F.lit(K.MAP_HEIGHT) - F.col("_high") * scale) / F.lit(2.0)
                   + F.col("_up") * scale),
                "units_per_metre": scale * F.lit(10.0),
            }
        )
        .drop(
            "_span_x", "_span_y", "_min_x", "_max_x", "_min_y", "_max_y", "_upright", "_turned",
            "_scale", "_right", "_up", "_wide", "_high",
        )
    )


def cut_points(points: DataFrame) -> DataFrame:
    """Projected points with `segment`, which rises where the position signal was lost, and
    `zone`, which also rises at every point without brake."""
    columns = ["map_x", "map_y", "distance"]
    placed = ordered.cut(_projected(points), ordered.bucket("distance", PIECE_M))
    moved = ordered.previous(placed, K.LAP, ORDER, columns, "_before")
    dx = F.col("map_x") - F.col("_before.map_x")
    dy = F.col("map_y") - F.col("_before.map_y")
    metres = F.col("distance") - F.col("_before.distance")
    chord = F.sqrt(dx * dx + dy * dy)
    expected = F.greatest(metres * F.col("units_per_metre"), F.lit(0.0))
    lost = chord > F.greatest(expected * F.lit(K.CUT_TOLERANCE), F.lit(float(K.CUT_MINIMUM)))
    cuts = F.coalesce(lost, F.lit(False)).cast("int")
    ends = F.when(F.col("brake") == 0, F.lit(1)).otherwise(cuts)
    counted = ordered.running_sum(moved, K.LAP, ORDER, segment=cuts, zone=ends)
    return counted.withColumns(
        {"segment": F.col("segment").cast("int"), "zone": F.col("zone").cast("int")}
    ).drop("_before", "_piece")


def _runs(df: DataFrame, keys: list[str]) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("distance").alias("from_m"),
            F.max("distance").alias("to_m"),
        )
        .where(F.col("points") > 1)
    )


def track_segments(points: DataFrame) -> DataFrame:
    """The drawable pieces of each lap: stretches of more than one point between cuts."""
    return _runs(cut_points(points), [*K.LAP, "segment"])


def braking_zones(points: DataFrame) -> DataFrame:
    """Stretches of more than one braking point; a cut or a released brake ends a stretch."""
    braking = cut_points(points).where(F.col("brake") != 0)
    return _runs(braking, [*K.LAP, "segment", "zone"])


def nearest_sample(projected: DataFrame, queries: DataFrame) -> DataFrame:
    """The point of the lap nearest to each query (LAP columns, query_id, qx, qy), if close.

    A join on grid cells a little wider than the pick radius: a query looks into its own cell
    and the eight around it. Points at the same place are merged to the earliest one first,
    so a stalled position does not fill a cell.
    """
    cell = F.lit(float(K.PICK_CELL))
    places = (
        projected.groupBy(*K.LAP, "map_x", "map_y")
        .agg(F.min("distance").alias("distance"))
        .withColumn("_cx", F.floor(F.col("map_x") / cell))
        .withColumn("_cy", F.floor(F.col("map_y") / cell))
    )
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = (
        queries.withColumn("_sx", F.explode(around))
        .withColumn("_sy", F.explode(around))
        .withColumn("_cx", F.floor(F.col("qx") / cell) + F.col("_sx"))
        .withColumn("_cy", F.floor(F.col("qy") / cell) + F.col("_sy"))
    )
    dx, dy = F.col("map_x") - F.col("qx"), F.col("map_y") - F.col("qy")
    return (
        asked.join(places, [*K.LAP, "_cx", "_cy"])
        .withColumn("_d2", dx * dx + dy * dy)
        .where(F.col("_d2") < K.PICK_DISTANCE_SQUARED)
        .groupBy(*K.LAP, "query_id")
        .agg(F.min(F.struct("_d2", "distance")).alias("_best"))
        .select(
            *K.LAP,
            "query_id",
            F.col("_best.distance").alias("distance"),
            F.sqrt("_best._d2").alias("map_distance"),
        )
    )

"""Pit-stop strategy: what a stint costs, and the lap at which one stop costs least.

A prediction grid has one row per (compound, stint, tyre, lap) and `pred`, the seconds lost
on that lap. It always has 3 x 2 x 60 x 80 = 28,800 rows, whatever the size of the lake, so
it may be broadcast. Laps and tyre lives beyond the grid use its last row or column.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C

LAST_TYRE = K.GRID_TYRES - 1
LAST_LAP = K.GRID_LAPS - 1


def grid_cells(spark) -> DataFrame:
    """All (compound, stint, tyre, lap) combinations of a grid."""

    def each(values, name):
        return F.explode(F.lit(values) if isinstance(values, list) else values).alias(name)

    compounds = spark.range(1).select(each(F.array(*map(F.lit, K.DRY_COMPOUNDS)), "compound"))
    stints = compounds.select("*", each(F.array(F.lit(1), F.lit(2)), "stint"))
    tyres = stints.select("*", each(F.sequence(F.lit(0), F.lit(LAST_TYRE)), "tyre"))
    return tyres.select("*", each(F.sequence(F.lit(0), F.lit(LAST_LAP)), "lap"))


def cost_tables(grid: DataFrame) -> DataFrame:
    """One row per (compound, stint): the array `ahead` over the cells, and the last cell.

    On a stint tyre life and lap number rise together until both stand at the last cell.
    `ahead` holds, per cell, the sum of (pred - pred of the last cell) over the laps until
    then. The cost of any run of n laps follows from two entries:
    ahead[start] - ahead[start moved by n] + n * pred[last cell].
    """
    cells = grid.select("compound", "stint", "tyre", "lap", "pred")
    last = cells.where((F.col("tyre") == LAST_TYRE) & (F.col("lap") == LAST_LAP)).select(
        "compound", "stint", F.col("pred").alias("limit")
    )
    # Every cell lies on the walk from a cell of the first row or column.
    walks = (
        cells.where((F.col("tyre") == 0) | (F.col("lap") == 0))
        .select(
            "compound",
            "stint",
            (F.col("lap") - F.col("tyre")).alias("walk"),
            F.col("tyre").alias("_tyre"),
            F.col("lap").alias("_lap"),
            F.explode(F.sequence(F.lit(0), F.lit(LAST_TYRE + LAST_LAP))).alias("k"),
        )
        .withColumns({"at_tyre": F.col("_tyre") + F.col("k"), "at_lap": F.col("_lap") + F.col("k")})
        .withColumns(
            {
                "tyre": F.least("at_tyre", F.lit(LAST_TYRE)),
                "lap": F.least("at_lap", F.lit(LAST_LAP)),
            }
        )
    )
    onward = Window.partitionBy("compound", "stint", "walk").orderBy(F.desc("k"))
    return (
        walks.join(F.broadcast(cells), ["compound", "stint", "tyre", "lap"])
        .join(F.broadcast(last), ["compound", "stint"])
        .withColumn(
            "ahead",
            F.sum(F.col("pred") - F.col("limit")).over(
                onward.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .where((F.col("at_tyre") <= LAST_TYRE) & (F.col("at_lap") <= LAST_LAP))
        .groupBy("compound", "stint", "limit")
        .agg(F.array_sort(F.collect_list(F.struct("tyre", "lap", "ahead"))).alias("cells"))
        .select("compound", "stint", "limit", "cells.ahead")
    )


def _at(values: Column, tyre: Column, lap: Column) -> Column:
    tyre = F.least(tyre, F.lit(LAST_TYRE))
    lap = F.least(lap, F.lit(LAST_LAP))
    return F.get(values, (tyre * K.GRID_LAPS + lap).cast("int"))


def _run_cost(table: Column, tyre: Column, first: Column, laps: Column) -> Column:
    """Cost of `laps` laps from lap `first` on a tyre of age `tyre`."""
    return (
        _at(table["ahead"], tyre, first)
        - _at(table["ahead"], tyre + laps, first + laps)
        + laps * table["limit"]
    )


def _with_table(requests: DataFrame, tables: DataFrame, compound: str, stint, name: str):
    """Adds the cost table of (compound, stint) as struct `name`; at most six rows exist."""
    side = tables.select(
        F.col("compound").alias(compound),
        F.col("stint").alias("_stint"),
        F.struct("limit", "ahead").alias(name),
    )
    return (
        requests.withColumn("_stint", stint)
        .join(F.broadcast(side), [compound, "_stint"], "left")
        .drop("_stint")
    )


def stint_cost(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds `cost` of the laps from_lap..to_lap on `compound` in `stint`, the tyre being
    `start_tyre` laps old on the first of them."""
    laps = F.greatest(F.col("to_lap") - F.col("from_lap") + 1, F.lit(0))
    priced = _with_table(requests, cost_tables(grid), "compound", F.col("stint"), "_table")
    cost = _run_cost(F.col("_table"), F.col("start_tyre"), F.col("from_lap"), laps)
    return priced.withColumn("cost", cost).drop("_table")


def _candidates() -> Column:
    """Laps at which the stop can cost least.

    A stop is allowed from 3 laps after the start to 3 laps before the end. Between `low` and
    `high` both stints only add last-cell laps, so the cost changes by the same amount per
    lap there and its minimum lies at one of the two ends: the laps strictly between need
    not be listed, however long the race is.
    """
    first = F.col("start_lap") + K.STOP_MARGIN_LAPS
    last = F.col("total_laps") - K.STOP_MARGIN_LAPS
    low = F.greatest(
        F.lit(LAST_LAP), F.col("start_lap") + LAST_TYRE - F.col("start_tyre"), first
    )
    high = F.least(F.col("total_laps") - LAST_TYRE, last)
    short = F.concat(F.sequence(first, low), F.sequence(high, last))
    return F.when(last > first, F.when(high > low, short).otherwise(F.sequence(first, last)))


def best_stop(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds `pit_window`, the cheapest stop lap (the earliest of equals), and its `cost`.

    Both are null when the race leaves no room for a stop or the grid lacks a compound. Costs
    are compared to the microsecond, so summing noise does not decide between equal laps. All
    candidates of a request are priced inside its row: nothing is shuffled.
    """
    tables = cost_tables(grid)
    priced = _with_table(requests, tables, "first_compound", F.lit(1), "_one")
    priced = _with_table(priced, tables, "second_compound", F.lit(2), "_two")

    def option(stop):
        first = _run_cost(
            F.col("_one"), F.col("start_tyre"), F.col("start_lap"), stop - F.col("start_lap") + 1
        )
        second = _run_cost(F.col("_two"), F.lit(1), stop + 1, F.col("total_laps") - stop)
        cost = C.half_up(first + F.col("pit_loss") + second, 6)
        return F.struct(cost.alias("cost"), stop.alias("stop"))

    best = F.array_min(F.transform(_candidates(), option))
    known = F.col("_one").isNotNull() & F.col("_two").isNotNull()
    return (
        priced.withColumn("_best", F.when(known, best))
        .withColumn("pit_window", F.col("_best.stop").cast("int"))
        .withColumn("cost", C.half_up("_best.cost", 2))
        .drop("_one", "_two", "_best")
    )


def stop_requests(laps: DataFrame) -> DataFrame:
    """One row per driver and race that started on a dry tyre: what the optimiser needs.

    The second compound is the one really fitted in stint 2 (at its first lap); if there was
    none, or it was a rain tyre, the usual alternative.
    """
    one, two = F.col("Stint") == 1, F.col("Stint") == 2

    def first_compound_of(stint):
        return F.min(F.when(stint, F.struct("LapNumber", "Compound")))["Compound"]

    drivers = laps.groupBy(*K.SESSION_DRIVER).agg(
        first_compound_of(one).alias("first_compound"),
        first_compound_of(two).alias("_fitted"),
        F.min(F.when(one, F.col("LapNumber"))).alias("start_lap"),
        F.coalesce(F.min(F.when(one, F.col("TyreLife"))), F.lit(0)).alias("start_tyre"),
        F.count_if(one).alias("stint1_laps"),
        F.min(F.when(two, F.col("LapNumber"))).alias("pit_real"),
    )
    totals = laps.groupBy(*K.RACE).agg(F.max("LapNumber").alias("total_laps"))
    other = F.element_at(C.literal_map(K.SECOND_COMPOUND), F.col("first_compound"))
    return (
        drivers.where(C.is_dry("first_compound"))
        .join(totals, K.RACE)
        .withColumn(
            "second_compound", F.when(C.is_dry("_fitted"), F.col("_fitted")).otherwise(other)
        )
        .withColumn("pit_loss", C.pit_loss("GrandPrix"))
        .drop("_fitted")
    )


def wear_slope(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds `wear_s_lap`, seconds lost per lap of tyre life between 5 and 20 laps of use."""

    def pred(tyre):
        return F.max(F.when(F.col("tyre") == tyre, F.col("pred")))

    slopes = (
        grid.where((F.col("stint") == 1) & F.col("tyre").isin(5, 20))
        .groupBy(F.col("compound").alias("first_compound"), F.col("lap").alias("_lap"))
        .agg(((pred(20) - pred(5)) / F.lit(15.0)).alias("_slope"))
    )
    return (
        requests.withColumn("_lap", F.least("start_lap", F.lit(LAST_LAP)))
        .join(F.broadcast(slopes), ["first_compound", "_lap"], "left")
        .withColumn("wear_s_lap", F.coalesce(C.half_up(C.half_up("_slope", 9), 3), F.lit(0.0)))
        .drop("_lap", "_slope")
    )


def predict_stops(laps: DataFrame, grid: DataFrame) -> DataFrame:
    """The prediction rows of the gold layer."""
    requests = wear_slope(stop_requests(laps), grid)
    return best_stop(requests, grid).select(
        F.col("Year").alias("year"),
        F.col("GrandPrix").alias("gp"),
        F.col("Driver").alias("driver"),
        F.col("first_compound").alias("compound_inicial"),
        F.col("second_compound").alias("compound_siguiente"),
        F.col("total_laps").alias("total_vueltas"),
        "pit_window",
        "pit_real",
        F.abs(F.col("pit_window") - F.col("pit_real")).alias("error_vueltas"),
        F.col("wear_s_lap").alias("degradacion_s_vuelta"),
        F.col("cost").alias("costo_estimado_s"),
        F.col("pit_loss").alias("pit_loss_usado"),
        F.col("stint1_laps").alias("vueltas_stint1"),
    )


def stop_summary(predictions: DataFrame) -> DataFrame:
    """How near the proposed stops come to the real ones."""
    error = F.col("error_vueltas")
    return predictions.agg(
        F.count(F.lit(1)).alias("predicciones_totales"),
        F.count(error).alias("comparables"),
        C.half_up(F.avg(error), 2).alias("mae_vueltas"),
        F.count_if(error <= 3).alias("aciertos_3_vueltas"),
        F.count_if(error <= 5).alias("aciertos_5_vueltas"),
    )


def merge_predictions(old: DataFrame, new: DataFrame, years: list[int]) -> DataFrame:
    """Replaces the predictions of the seasons just computed, keeps those of the others."""
    kept = old.where(F.col("year").isNull() | ~F.col("year").isin(*years))
    return kept.unionByName(new)


def strategy_lookup(
    predictions: DataFrame, metrics: DataFrame, year: int, gp: str, driver: str
) -> DataFrame:
    """One driver's prediction with the summary and the error of the model of that season.

    `metrics` holds one record per era with the array `years`; the era is chosen by season.
    """
    found = predictions.where(
        (F.col("year") == year) & (F.col("gp") == gp) & (F.col("driver") == driver.upper())
    )
    era = metrics.where(F.array_contains("years", year)).select("era", "mae_segundos")
    summary = stop_summary(predictions).select(
        F.struct("predicciones_totales", "comparables", "mae_vueltas",
                 "aciertos_3_vueltas", "aciertos_5_vueltas").alias("resumen")
    )
    model = era.agg(F.min(F.struct("era", "mae_segundos"))).scalar()
    return found.select("*", summary.scalar().alias("resumen"), model.alias("modelo"))


def strategy_card(predictions: DataFrame) -> DataFrame:
    """What the strategy card shows: signed difference, its label, and both places in the
    race in percent; wear counts as measurable above a fixed threshold."""
    difference = F.col("pit_window") - F.col("pit_real")

    def place(name):
        share = F.col(name) / F.col("total_vueltas") * F.lit(100.0)
        return F.when(F.col(name).isNotNull(), C.clamp(share, 0.0, 100.0))

    return predictions.select(
        "year",
        "gp",
        "driver",
        difference.alias("difference"),
        F.when(difference > 0, "late").when(difference < 0, "early").when(
            difference == 0, "exact"
        ).alias("verdict"),
        place("pit_window").alias("window_pct"),
        place("pit_real").alias("real_pct"),
        (F.col("degradacion_s_vuelta") > K.MEASURABLE_WEAR).alias("measurable"),
    )

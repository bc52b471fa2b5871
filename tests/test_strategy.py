import random

import pytest
from pyspark.sql import functions as F

from stintlake.operators import strategy
from stintlake.plans import fixtures

REQUEST = (
    "id int, first_compound string, second_compound string, start_lap int, start_tyre int, "
    "total_laps int, pit_loss double"
)


def loss_of(grid, compound, stint, ages):
    """Sum over a stint, given the (tyre age, lap) pairs driven; the grid's edge holds beyond it."""
    return sum(grid[compound, stint, min(age, 59), min(lap, 79)] for age, lap in ages)


def cheapest_stop(grid, one, two, start, tyre, total, loss):
    """(lap, cost) of the cheapest stop three or more laps from either end, the earliest of equal
    ones; None without such a lap."""

    def priced(stop):
        before = zip(range(tyre, tyre + total), range(start, stop + 1), strict=False)
        after = zip(range(1, total + 1), range(stop + 1, total + 1), strict=False)
        return round(loss_of(grid, one, 1, before) + loss + loss_of(grid, two, 2, after), 6)

    stops = range(start + 3, total - 2) if start + 6 < total else ()
    cost, lap = min(((priced(stop), stop) for stop in stops), default=(None, None))
    return None if lap is None else (lap, cost)


@pytest.fixture(scope="module")
def random_grid(spark):
    """Integer losses, so that sums are exact in any order."""
    cells = strategy.grid_cells(spark)
    pred = F.pmod(F.xxhash64("compound", "stint", "tyre", "lap"), F.lit(1000)).cast("double")
    grid = cells.withColumn("pred", pred)
    rows = {(r["compound"], r["stint"], r["tyre"], r["lap"]): r["pred"] for r in grid.collect()}
    assert len(rows) == 28800
    return grid, rows


def requests(spark, count, longest, seed):
    rng = random.Random(seed)
    kinds = ["SOFT", "MEDIUM", "HARD"]
    rows = []
    for i in range(count):
        rows.append((
            i, rng.choice(kinds), rng.choice(kinds), rng.randrange(1, 12), rng.randrange(0, 90),
            rng.randrange(5, longest), float(rng.randrange(18, 28)),
        ))
    return spark.createDataFrame(rows, REQUEST), rows


@pytest.mark.parametrize("longest", [60, 130, 900])
def test_best_stop_equals_trying_every_lap(spark, random_grid, longest):
    grid, cells = random_grid
    df, rows = requests(spark, 40, longest, longest)
    found = {r["id"]: r for r in strategy.best_stop(df, grid).collect()}
    for i, one, two, start, tyre, total, loss in rows:
        wanted = cheapest_stop(cells, one, two, start, tyre, total, loss)
        if wanted is None:
            assert found[i]["pit_window"] is None and found[i]["cost"] is None
        else:
            assert (found[i]["pit_window"], found[i]["cost"]) == wanted


def test_long_races_list_few_candidates(spark, random_grid):
    df = spark.createDataFrame([(1, "SOFT", "HARD", 1, 0, 1_000_000, 20.0)], REQUEST)
    listed = df.select(F.size(strategy._candidates()).alias("n")).first()["n"]
    assert listed < 200


def test_equal_costs_take_the_earliest_lap(spark):
    flat = strategy.grid_cells(spark).withColumn("pred", F.lit(0.1))
    df = spark.createDataFrame([(1, "SOFT", "HARD", 1, 0, 40, 20.0)], REQUEST)
    found = strategy.best_stop(df, flat).first()
    assert (found["pit_window"], found["cost"]) == (4, 24.0)


def test_unknown_compound_has_no_stop(spark, random_grid):
    df = spark.createDataFrame([(1, "WET", "HARD", 1, 0, 40, 20.0)], REQUEST)
    assert strategy.best_stop(df, random_grid[0]).first()["pit_window"] is None


def test_stint_cost(spark, random_grid):
    grid, cells = random_grid
    rng = random.Random(3)
    rows = []
    for i in range(30):
        first = rng.randrange(1, 95)
        rows.append((i, "MEDIUM", rng.choice([1, 2]), rng.randrange(0, 80), first,
                     first + rng.randrange(-1, 90)))
    df = spark.createDataFrame(
        rows, "id int, compound string, stint int, start_tyre int, from_lap int, to_lap int"
    )
    for r in strategy.stint_cost(df, grid).collect():
        driven = range(r["from_lap"], r["to_lap"] + 1)
        ages = ((r["start_tyre"] + k, lap) for k, lap in enumerate(driven))
        wanted = loss_of(cells, "MEDIUM", r["stint"], ages)
        assert r["cost"] == pytest.approx(wanted, abs=1e-6)


LAPS = (
    "Year int, GrandPrix string, Driver string, LapNumber int, Stint int, Compound string, "
    "TyreLife int"
)


def test_requests(spark):
    def stint(driver, number, first, last, compound):
        return [
            (2024, "monaco_grand_prix", driver, lap, number, compound, lap - first + 1)
            for lap in range(first, last + 1)
        ]

    rows = (
        stint("DRY", 1, 1, 10, "SOFT") + stint("DRY", 2, 11, 30, "MEDIUM")
        + stint("ONE", 1, 1, 28, "HARD")
        + stint("WET", 1, 1, 9, "INTERMEDIATE") + stint("WET", 2, 10, 30, "SOFT")
        + stint("RAIN2", 1, 2, 9, "MEDIUM") + stint("RAIN2", 2, 10, 30, "WET")
        + [(2024, "monaco_grand_prix", "NONE", 1, None, "SOFT", 0)]
    )
    laps = spark.createDataFrame(rows, LAPS)
    found = {r["Driver"]: r for r in strategy.stop_requests(laps).collect()}
    assert set(found) == {"DRY", "ONE", "RAIN2"}
    assert (found["DRY"]["second_compound"], found["DRY"]["pit_real"]) == ("MEDIUM", 11)
    assert (found["ONE"]["second_compound"], found["ONE"]["pit_real"]) == ("MEDIUM", None)
    assert found["RAIN2"]["second_compound"] == "HARD"
    assert found["RAIN2"]["start_lap"] == 2
    assert {r["total_laps"] for r in found.values()} == {30}
    assert {r["pit_loss"] for r in found.values()} == {19.0}


def test_merge_keeps_other_seasons(spark):
    old = spark.createDataFrame([(2024, "a"), (2025, "b"), (2026, "c")], "year int, v string")
    new = spark.createDataFrame([(2024, "x"), (2025, "y")], "year int, v string")
    merged = strategy.merge_predictions(old, new, [2024, 2025]).collect()
    assert sorted((r["year"], r["v"]) for r in merged) == [(2024, "x"), (2025, "y"), (2026, "c")]


def test_summary_without_comparable_rows(spark):
    rows = spark.createDataFrame([(None,), (None,)], "error_vueltas int")
    found = strategy.stop_summary(rows).first()
    assert (found["predicciones_totales"], found["comparables"]) == (2, 0)
    assert found["mae_vueltas"] is None
    assert found["aciertos_3_vueltas"] == 0


def test_formula_grid_slope(spark):
    laps = spark.createDataFrame(
        [(2024, "x", "A", lap, 1, "SOFT", lap) for lap in range(1, 30)], LAPS
    )
    slopes = strategy.wear_slope(strategy.stop_requests(laps), fixtures.formula_grid(spark))
    assert slopes.first()["wear_s_lap"] == 0.09

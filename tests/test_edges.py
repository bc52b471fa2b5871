"""Hand-made frames for the edges the generated tables do not reach."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stintlake.functions import columns as C
from stintlake.operators import (
    catalogue, cleaning, gaps, laps as lap_ops, pace, preparation, quality, wear_model,
)

TEL = (
    "Year int, GrandPrix string, Driver string, LapNumber int, Distance double, Speed double, "
    "X int, Y int"
)
LAPS = (
    "Year int, GrandPrix string, Driver string, Team string, LapNumber int, Stint int, "
    "Compound string, TyreLife int, LapTime double"
)


def telemetry(spark, laps, driver="AAA", race="gp"):
    """`laps` maps a lap number to a list of (distance, x, y)."""
    rows = [
        (2024, race, driver, n, float(d), 100.0, x, y)
        for n, samples in laps.items() for d, x, y in samples
    ]
    return spark.createDataFrame(rows, TEL)


def follow(n, step=10):
    return [(k * step, k * step * 10, 0) for k in range(n)]


def test_quality_needs_twenty_samples_and_a_step(spark):
    df = telemetry(
        spark,
        {
            1: follow(19),
            2: follow(20),
            3: [(k * 0.4, k, 0) for k in range(30)],
            4: [(k * 10, 0, 0) for k in range(30)],
            5: follow(10) + [(100 + k * 10, 900, 0) for k in range(10)],
        },
    )
    found = {r["LapNumber"]: r["quality"] for r in quality.lap_position_quality(df).collect()}
    assert found[1] == 0 and found[2] == 1 and found[3] == 0 and found[4] == 0
    assert found[5] == pytest.approx(1 - 100 / 190, abs=0.001)


def test_race_quality_takes_first_driver_and_middle_lap(spark):
    good, bad = follow(25), [(k * 10, 0, 0) for k in range(25)]
    df = telemetry(spark, {3: bad, 7: good, 9: bad, 30: bad}, "BBB").unionAll(
        telemetry(spark, {1: bad, 2: bad, 8: good, 9: bad}, "AAA")
    )
    found = quality.race_position_quality(df).first()
    assert (found["Driver"], found["LapNumber"], found["position_ok"]) == ("AAA", 8, True)


def test_jumps_are_incoherent(spark):
    df = telemetry(spark, {1: [(0, 0, 0), (10, 100, 0), (20, 400, 0), (20.2, 900, 0)]})
    assert quality.incoherent_samples(df).first()["incoherent"] == 1


def test_equal_distances_do_not_break_deltas(spark):
    df = telemetry(spark, {1: [(0, 0, 0), (10, 100, 0), (10, 100, 0), (20, 200, 0)]})
    assert sorted(r["arc"] for r in quality.sample_deltas(df).collect() if r["arc"] is not None) == [
        0, 10, 10,
    ]


def test_selected_lap(spark):
    laps = {2: follow(3), 5: follow(4), 9: [(0, 0, 0)]}
    df = telemetry(spark, laps)
    # Lap 9 has no positioned sample, and neither has the first sample of the others.
    assert {r["LapNumber"] for r in lap_ops.select_lap(df).collect()} == {5}
    assert lap_ops.select_lap(df, 2).count() == 2
    assert lap_ops.select_lap(df, 9).isEmpty()
    assert sorted(r["LapNumber"] for r in lap_ops.unknown_lap(df, 9).collect()) == [2, 5]
    assert lap_ops.unknown_lap(df, 2).isEmpty()


def test_points_round_and_fill(spark):
    df = telemetry(spark, {1: [(12.34, 5, 6)]}).withColumns(
        {
            "RPM": F.lit(None).cast("int"), "nGear": F.lit(3), "Throttle": F.lit(float("inf")),
            "Brake": F.lit(1), "DRS": F.lit(12), "Speed": F.lit(float("nan")),
            "Compound": F.lit(None).cast("string"),
        }
    )
    r = lap_ops.lap_points(df).first()
    assert (r["distance"], r["speed"], r["rpm"], r["throttle"], r["compound"]) == (12.3, 0, 0, 0, "")


def test_progress_of_short_laps(spark):
    points = spark.createDataFrame(
        [(2024, "g", "A", 1, 5.0, 0, 0), (2024, "g", "A", 2, 5.0, 0, 0), (2024, "g", "A", 2, 15.0, 0, 0)],
        "Year int, GrandPrix string, Driver string, LapNumber int, distance double, x int, y int",
    )
    rows = lap_ops.lap_progress(points).orderBy("LapNumber", "distance").collect()
    assert [(r["progress_pct"], r["distance_ratio"]) for r in rows] == [(0, 0), (0, 0), (100, 1)]


def test_fastest_lap_ties_take_the_earlier(spark):
    laps = spark.createDataFrame(
        [(2024, "g", "A", "T", n, 1, "SOFT", n, t) for n, t in ((1, None), (2, 90.0), (3, 90.0))], LAPS
    )
    assert lap_ops.fastest_laps(laps).first()["LapNumber"] == 2


def test_cleaning_fills_before_it_filters(spark):
    raw = spark.createDataFrame(
        [("A", 1, 100.0, True), ("A", None, 100.0, None), ("A", 2, None, False), ("A", 3, 5.0, None)],
        "Driver string, LapNumber int, Speed double, Brake boolean",
    ).withColumns(
        {
            "Year": F.lit(2024), "GrandPrix": F.lit("g"), "Team": F.lit(None).cast("string"),
            **{
                n: F.lit(None).cast("double")
                for n in ("SessionTime", "Distance", "RPM", "nGear", "Throttle", "DRS", "X", "Y",
                          "DistanceToDriverAhead")
            },
            "Compound": F.lit("SOFT"), "DriverAhead": F.lit(None).cast("string"),
        }
    )
    rows = {r["LapNumber"]: r for r in cleaning.clean_telemetry(raw).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["Brake"], rows[3]["Brake"], rows[3]["RPM"], rows[3]["Team"]) == (1, 0, 0, None)


def test_messages(spark):
    df = spark.createDataFrame(
        [("Flag", None, "12"), (None, "RED", "12.0"), ("Other", "X", "x"), ("Flag", "", None)],
        "Category string, Flag string, Lap string",
    )
    rows = preparation.clean_events(df).collect()
    assert [r["Lap"] for r in rows] == [12, 12, 0, 0]
    assert [r["Flag"] for r in rows] == ["", "RED", "X", ""]
    raced = df.withColumns({"Year": F.lit(2024), "GrandPrix": F.lit("g")})
    counted = preparation.events_summary(raced.drop("Category")).first()
    assert (counted["messages"], counted["flags"]) == (4, 4)


def test_missing_channels_become_zero(spark):
    df = preparation.ensure_columns(spark.createDataFrame([("A", 1)], "Driver string, LapNumber int"))
    row = df.first()
    assert row["DRS"] == 0 and row["Driver"] == "A" and len(df.columns) == 16


def test_laps_from_the_feed(spark):
    df = spark.createDataFrame(
        [(timedelta(minutes=1, seconds=30, milliseconds=125), date(2024, 3, 2), "AAA", 7)],
        "LapTime interval day to second, LapStartDate date, Driver string, Other int",
    )
    row = preparation.normalise_laps(df, 2024, "São Paulo Grand Prix").first()
    assert (row["LapTime"], row["LapStartDate"], row["Other"]) == (90.125, "2024-03-02", 7)
    assert (row["Year"], row["GrandPrix"]) == (2024, "são_paulo_grand_prix")


def test_lap_join_is_half_open_and_survives_long_laps(spark):
    key = "Year int, GrandPrix string, Driver string"
    laps = spark.createDataFrame(
        [(2024, "g", "A", "T", 1, "SOFT", 0.0, 90.0), (2024, "g", "A", "T", 2, "SOFT", 90.0, 4000.0),
         (2024, "g", "A", "T", None, "SOFT", 4000.0, 4100.0)],
        f"{key}, Team string, LapNumber int, Compound string, LapStart double, LapEnd double",
    )
    samples = spark.createDataFrame(
        [(2024, "g", "A", t) for t in (0.0, 89.9, 90.0, 3999.0, 4000.0, -1.0)]
        + [(2024, "g", "B", 5.0)],
        f"{key}, SessionTime double",
    )
    joined = preparation.assemble_telemetry(samples, laps, 60)
    assert sorted((r["SessionTime"], r["LapNumber"]) for r in joined.collect()) == [
        (0.0, 1), (89.9, 1), (90.0, 2), (3999.0, 2),
    ]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pending_races(spark):
    calendar = spark.createDataFrame([(2024, "Monza Grand Prix"), (2024, "Spa")], "Year int, EventName string")
    done = spark.createDataFrame([(2024, "spa")], "Year int, GrandPrix string")
    assert [r["GrandPrix"] for r in preparation.pending_races(calendar, done).collect()] == [
        "monza_grand_prix"
    ]
    assert preparation.pending_races(calendar, done, overwrite=True).count() == 2


def test_names(spark):
    df = spark.createDataFrame([("são_paulo_grand_prix",), ("las_palmas_grand_prix",)], "s string")
    assert [r[0] for r in df.select(C.display_name("s")).collect()] == ["São Paulo", "Las Palmas"]
    people = spark.createDataFrame([(" Ana  Luz Ruiz ",), ("Zhou",)], "n string")
    assert [r[0] for r in people.select(C.surname("n")).collect()] == ["Luz Ruiz", "Zhou"]


def test_team_ties_and_fallbacks(spark):
    laps = spark.createDataFrame(
        [(2024, "b", "A", t, n, 1, "SOFT", 1, 90.0) for n, t in enumerate(["T2", "T1", "T2", "T1"])]
        + [(2024, "c", "A", "T9", 1, 1, "SOFT", 1, 90.0)], LAPS,
    )
    teams = catalogue.team_by_race(laps)
    assert {(r["GrandPrix"], r["Team"]) for r in teams.collect()} == {("b", "T1"), ("c", "T9")}
    assert catalogue.team_by_season(teams).first()["Team"] == "T1"
    tel = telemetry(spark, {1: follow(2)}, "A", "d").unionAll(
        telemetry(spark, {1: follow(2)}, "Z", "d")
    )
    calendar = spark.createDataFrame([(2024, "D")], "Year int, EventName string")
    names = spark.createDataFrame([], "Year int, Driver string, name string")
    found = catalogue.catalogue_drivers(calendar, tel, laps, names).collect()
    assert {(r["code"], r["team"], r["name"]) for r in found} == {
        ("A", "T1", "A"), ("Z", "Sin equipo", "Z"),
    }


def test_holdout_ties_take_the_first_name(spark):
    rows = [("x", gp) for gp in "babac"] + [("y", "b")]
    df = spark.createDataFrame(rows, "era string, GrandPrix string")
    found = {tuple(r) for r in wear_model.holdout_circuit(df).collect()}
    assert found == {("x", "a", 2), ("y", "b", 1)}
    split = wear_model.holdout_split(df).where("validation").collect()
    assert sorted(map(tuple, split)) == [("x", "a", True), ("x", "a", True), ("y", "b", True)]
    assert wear_model.holdout_circuit(df, "c").first()["laps"] == 1


def test_unknown_compound_is_wet_only_on_request(spark):
    df = spark.createDataFrame([("SOFT",), ("WET",), (None,)], "Compound string")
    assert [r[0] for r in df.select(pace.wet_flag()).collect()] == [False, True, False]
    assert [r[0] for r in df.select(pace.wet_flag(compat=True)).collect()] == [False, True, True]


def test_features_drop_incomplete_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "SOFT", 0.1), (1, 1, None, "SOFT", 0.1), (1, 1, 1, "HARD", 0.2)],
        "TyreLife int, LapNumber int, Stint int, Compound string, LapTimeDelta double",
    )
    rows = wear_model.features(df).collect()
    assert [(r["Compound_SOFT"], r["Compound_MEDIUM"], r["Compound_HARD"]) for r in rows] == [
        (1, 0, 0), (0, 0, 1),
    ]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = wear_model.regression_metrics(df, "y", "p").first()
    assert r["rmse"] == pytest.approx((2 / 3) ** 0.5)
    assert r["mae"] == pytest.approx(2 / 3)
    assert r["r2"] == pytest.approx(1 - 2 / 8)
    assert r["mape"] == pytest.approx(40)


GAP = "Year int, GrandPrix string, Driver string, LapNumber int, Distance double, SessionTime double"


def test_gap_compares_places_at_one_instant(spark):
    """Places at second 60 lie between the samples around it; a bad sample doesn't set the lap
    length; a car that hasn't started takes no part."""
    rows = [
        (2024, "g", "A", 1, 900.0, 30.0), (2024, "g", "A", 2, 100.0, 50.0), (2024, "g", "A", 2, 300.0, 70.0),
        (2024, "g", "B", 1, 800.0, 55.0), (2024, "g", "B", 1, 1000.0, 65.0),
        (2024, "g", "C", 1, 99999.0, 61.0), (2024, "g", "C", 1, 99999.0, 62.0),
        (2024, "g", "D", 1, 1000.0, 100.0), (2024, "g", "D", 1, 1000.0, 100.0),
    ]
    found = {
        r["Driver"]: (r["covered_m"], r["driver_ahead"], r["gap_m"])
        for r in gaps.gap_ahead(spark.createDataFrame(rows, GAP), 60).collect()
    }
    assert found == {"A": (1200.0, None, None), "B": (900.0, "A", 300.0)}


def test_gap_in_a_crowded_instant_is_the_same(spark, monkeypatch):
    rows = [
        (2024, "g", f"D{k:03}", 1 + k % 2, float((k * 37) % 50 + t), float(k % 50 + t))
        for k in range(200) for t in (0, 20, 45)
    ]
    df = spark.createDataFrame(rows, GAP)

    def found():
        return sorted(map(str, gaps.gap_ahead(df, 60).collect()))

    whole = found()
    assert len(whole) > 100
    monkeypatch.setattr(gaps, "PIECE_M", 3.0)
    assert found() == whole


def test_as_of_join_of_a_hot_group(spark):
    """One race with all rows, cut into many stretches; ties, nulls and instants before any state."""
    from stintlake.functions import asof

    pick = random.Random(2)
    left = [("x", pick.choice([None, float(pick.randint(-50, 400))]), i) for i in range(400)]
    left += [(None, 5.0, 1000), ("y", 5.0, 1001)]
    right = [("x", float(pick.randint(0, 380)), pick.choice("abc")) for _ in range(60)]
    right += [(None, 4.0, "n"), ("x", None, "never"), ("z", 1.0, "other"), ("x", 100.0, "a"), ("x", 100.0, "z")]
    a = spark.createDataFrame(left, "GrandPrix string, t double, n int")
    b = spark.createDataFrame(right, "GrandPrix string, t double, state string")
    for width in (1.0, 30.0, 1e6):
        found = asof.last_before(a, b, ["GrandPrix"], "t", ["state"], width).collect()
        assert len(found) == len(left)
        for r in found:
            known = [
                (t, s) for gp, t, s in right
                if gp == r["GrandPrix"] and t is not None and r["t"] is not None and t <= r["t"]
            ]
            assert (r["_since"], r["state"]) == max(known, default=(None, None))
    assert asof.last_before(a, b.limit(0), ["GrandPrix"], "t", ["state"], 9.0).where("state IS NOT NULL").isEmpty()
    assert asof.last_before(a.limit(0), b, ["GrandPrix"], "t", ["state"], 9.0).isEmpty()


def test_grid_points(spark):
    rows = [
        (2024, "m", "A", 1, d, s, 50.0, b) for d, s, b in
        [(3.0, 100.0, 0), (10.0, 110.0, 1), (10.0, 90.0, 0), (37.0, 120.0, 1), (40.0, 126.0, 0), (None, 1.0, 1)]
    ] + [(2024, "m", "B", 1, 20.0, None, 1.0, 1), (2024, "m", "C", 1, 21.0, 5.0, 1.0, 1)]
    df = spark.createDataFrame(
        rows, "Year int, GrandPrix string, Driver string, LapNumber int, Distance double, "
        "Speed double, Throttle double, Brake int",
    )
    found = sorted((r.Driver, r.Distance, r.Speed, r.Brake) for r in lap_ops.on_grid(df, 10.0).collect())
    assert found[:4] == [
        ("A", 10.0, 90.0, 0), ("A", 20.0, pytest.approx(90 + 30 * 10 / 27), 0),
        ("A", 30.0, pytest.approx(90 + 30 * 20 / 27), 0), ("A", 40.0, 126.0, 0),
    ]
    assert found[4:] == [("B", 20.0, None, 1)]

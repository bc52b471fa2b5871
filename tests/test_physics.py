"""The derived forces against a plain walk over the points of each lap."""

import cmath
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stintlake.functions import columns as C
from stintlake.functions import ordered
from stintlake.operators import laps as lap_ops
from stintlake.operators import physics, preparation, quality, track

POINTS = (
    "Year int, GrandPrix string, Driver string, LapNumber int, compound string, distance double, "
    "speed double, rpm int, gear int, throttle int, brake int, drs int, x int, y int"
)


def lap(number, samples):
    return [
        (2024, "gp", "AAA", number, "SOFT", dm / 10, speed, 11000, 7, 90, brake, 12, x, y)
        for dm, speed, brake, x, y in samples
    ]


def random_lap(seed, n):
    rng = random.Random(seed)
    samples, dm, x, y = [], 0, 100, 100
    for _ in range(n):
        dm += rng.choice([1, 3, 60, 150, 199, 200, 201, 460])
        if rng.random() < 0.8:
            x, y = x + rng.randrange(-150, 151), y + rng.randrange(-150, 151)
        samples.append((dm, float(rng.randrange(60, 340)), rng.randrange(2), x, y))
    return samples


def neighbour_indexes(samples):
    """By definition: the last point at least 200 dm behind and the first one as far ahead, or
    the first and last point of the lap."""
    ways = [s[0] for s in samples]
    last = len(ways) - 1
    return {
        i: (
            max((j for j in range(last + 1) if ways[j] <= ways[i] - 200), default=0),
            min((j for j in range(last + 1) if ways[j] >= ways[i] + 200), default=last),
        )
        for i in range(1, last)
    }


def expected_forces(samples):
    """Lateral and longitudinal force of each point, from the definitions."""
    lateral, longitudinal = [0.0] * len(samples), [0.0] * len(samples)
    for i, (a, b) in neighbour_indexes(samples).items():
        way, speed, place = (
            [samples[k][0] / 10 for k in (a, i, b)],
            [samples[k][1] / 3.6 for k in (a, i, b)],
            [complex(samples[k][3], samples[k][4]) / 10 for k in (a, i, b)],
        )
        legs = place[1] - place[0], place[2] - place[1]
        arcs = way[1] - way[0], way[2] - way[1]
        bend = abs(math.remainder(cmath.phase(legs[1]) - cmath.phase(legs[0]), math.tau))
        coherent = all(arc > 1 and abs(leg) <= 1.15 * arc for arc, leg in zip(arcs, legs, strict=True))
        if coherent and sum(arcs) > 2:
            lateral[i] = speed[1] ** 2 * bend / (sum(arcs) / 2) / 9.81
        if sum(arcs) > 1:
            longitudinal[i] = speed[1] * (speed[2] - speed[0]) / sum(arcs) / 9.81
    return lateral, longitudinal


def moving_median(values):
    return [statistics.median_high(values[max(0, i - 3): i + 4]) for i in range(len(values))]


@pytest.fixture(scope="module")
def laps(spark):
    made = {n: random_lap(n, size) for n, size in enumerate([1, 2, 3, 7, 40, 200, 300], 1)}
    rows = [row for n, samples in made.items() for row in lap(n, samples)]
    random.Random(9).shuffle(rows)
    return made, spark.createDataFrame(rows, POINTS).repartition(5)


def by_lap(df, *names):
    found = {}
    for r in df.orderBy("LapNumber", "distance").collect():
        found.setdefault(r["LapNumber"], []).append(tuple(r[n] for n in names))
    return found


def test_neighbours_equal_the_walk(laps):
    made, df = laps
    found = by_lap(
        physics.neighbours(df).select(
            "LapNumber", "distance", F.col("before.dm").alias("b"), F.col("after.dm").alias("a")
        ), "b", "a",
    )
    for n, samples in made.items():
        wanted = neighbour_indexes(samples)
        for i, pair in enumerate(found[n]):
            expected = (None, None)
            if i in wanted:
                expected = tuple(samples[j][0] for j in wanted[i])
            assert pair == expected


def test_forces_equal_the_walk(laps):
    made, df = laps
    raw = by_lap(physics.raw_forces(df), "g_lat", "g_lon")
    smoothed = by_lap(physics.smoothed_forces(df), "g_lat", "g_lon")
    final = by_lap(physics.enrich(df), "g_lat", "g_lon")
    for n, samples in made.items():
        lat, lon = expected_forces(samples)
        assert [r[0] for r in raw[n]] == pytest.approx(lat)
        assert [r[1] for r in raw[n]] == pytest.approx(lon)
        lat, lon = moving_median(lat), moving_median(lon)
        assert [r[0] for r in smoothed[n]] == pytest.approx(lat)
        assert [r[1] for r in smoothed[n]] == pytest.approx(lon)
        if len(samples) < 3:
            assert set(final[n]) == {(0.0, 0.0)}
        for (g_lat, g_lon), a, b in zip(final[n], lat, lon):
            assert g_lat == pytest.approx(min(max(a, 0), 5.2), abs=0.00501)
            assert g_lon == pytest.approx(min(max(b, -6), 2.5), abs=0.00501)


def test_diagnostic_median_is_the_ordinary_one(laps):
    made, df = laps
    found = by_lap(physics.diagnostic_points(df), "g")
    for n in (5, 6):
        samples = made[n]
        lat, _ = expected_forces(samples)
        kept = [
            lat[i] for i, (a, b) in neighbour_indexes(samples).items() if samples[b][0] - samples[a][0] > 20
        ]
        wanted = [statistics.median(kept[max(0, i - 3): i + 4]) for i in range(len(kept))]
        assert [g for g, in found[n]] == pytest.approx(wanted)


def test_straight_is_light_and_arc_is_not(spark):
    straight = [(k * 100, 320.0, 0, k * 100, 0) for k in range(60)]
    radius = 500  # decimetres
    arc = [
        (k * 50, 200.0, 0, round(radius * math.cos(k * 0.1)), round(radius * math.sin(k * 0.1)))
        for k in range(60)
    ]
    df = spark.createDataFrame(lap(1, straight) + lap(2, arc), POINTS)
    found = {r["LapNumber"]: r for r in physics.g_diagnostic(df).collect()}
    assert found[1]["max_g"] == 0
    assert found[1]["fastest_radius_m"] == math.inf
    wanted = (200 / 3.6) ** 2 / 50 / 9.81
    assert found[2]["median_g"] == pytest.approx(wanted, rel=0.05)


def test_angle_wraps(spark):
    df = spark.createDataFrame([(math.radians(179), math.radians(-179))], "a double, b double")
    turn = df.select(C.angle_difference("b", "a").alias("d")).first()["d"]
    assert math.degrees(turn) == pytest.approx(2)


def test_rounding_below_zero(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-2.6,)], "v double")
    assert [r[0] for r in df.select(C.whole("v")).collect()] == [-2, 3, -3]


def test_gauges(spark):
    df = spark.createDataFrame(
        [(2024, "gp", "A", 1, 5000, 150.0, 12, 3.2, -4.0), (2024, "gp", "A", 1, 10000, 300.0, 8, 3.0, 1.0)],
        "Year int, GrandPrix string, Driver string, LapNumber int, rpm int, speed double, drs int, "
        "g_lat double, g_lon double",
    )
    low, high = physics.gauges(df).collect()
    assert (low["rev_ratio"], low["lit_lights"], low["drs_open"], low["high_load"]) == (0, 0, True, True)
    assert low["deceleration_g"] == 4 and high["deceleration_g"] == 0
    assert (high["rev_ratio"], high["lit_lights"], high["aero_load_pct"]) == (0.5, 8, 100)
    assert not high["drs_open"] and not high["high_load"]


def test_cuts_close_segments_and_braking(spark):
    # 10 m steps along a line; the position jumps back to the start between the 5th and 6th.
    samples = [(k * 100, 100.0, 1 if 3 <= k <= 6 else 0, (k % 5) * 100, 0) for k in range(10)]
    samples += [(1100, 100.0, 0, 90000, 0)]
    df = spark.createDataFrame(lap(1, samples), POINTS)
    segments = track.track_segments(df).orderBy("segment").collect()
    assert [r["points"] for r in segments] == [10]
    wide = spark.createDataFrame(lap(1, samples[:10]), POINTS)
    segments = track.track_segments(wide).orderBy("segment").collect()
    assert [r["points"] for r in segments] == [5, 5]
    zones = track.braking_zones(wide).orderBy("from_m").collect()
    assert [(r["from_m"], r["to_m"]) for r in zones] == [(30, 40), (50, 60)]


def test_projection_fits_the_box_and_turns_tall_laps(spark):
    tall = [(k * 10, 100.0, 0, k % 7, k * 10) for k in range(100)]
    df = spark.createDataFrame(lap(1, tall), POINTS)
    box = track.project_track(df).agg(
        F.min("map_x").alias("x0"), F.max("map_x").alias("x1"), F.min("map_y").alias("y0"),
        F.max("map_y").alias("y1"),
    ).first()
    assert box["x1"] - box["x0"] == pytest.approx(348)
    assert 26 <= box["y0"] and box["y1"] <= 294


def test_nearest_sample_equals_trying_all(spark, laps):
    made, df = laps
    drawn = track.project_track(df)
    rows = drawn.collect()
    rng = random.Random(4)
    asked = []
    for i in range(150):
        r = rng.choice(rows)
        asked.append((2024, "gp", "AAA", r["LapNumber"], i, r["map_x"] + rng.uniform(-15, 15),
                      r["map_y"] + rng.uniform(-15, 15)))
    queries = spark.createDataFrame(
        asked,
        "Year int, GrandPrix string, Driver string, LapNumber int, query_id int, qx double, qy double",
    )
    found = {r["query_id"]: r["distance"] for r in track.nearest_sample(drawn, queries).collect()}
    for _, _, _, n, i, qx, qy in asked:
        best = min(
            ((r["map_x"] - qx) ** 2 + (r["map_y"] - qy) ** 2, r["distance"])
            for r in rows if r["LapNumber"] == n
        )
        assert found.get(i) == (best[1] if best[0] < 140 else None)


def test_cut_laps_give_the_same_as_whole_ones(laps, monkeypatch):
    _, df = laps

    def results():
        return [
            sorted(map(str, frame.collect()))
            for frame in (
                track.track_segments(df), track.braking_zones(df), track.project_track(df),
                physics.g_top(df), lap_ops.lap_progress(df),
                physics.g_diagnostic(df).select("LapNumber", "points", "max_g", "fastest_g"),
                quality.sample_deltas(df.select(
                    "Year", "GrandPrix", "Driver", "LapNumber", F.col("distance").alias("Distance"),
                    F.col("x").alias("X"), F.col("y").alias("Y"),
                )),
            )
        ]

    def percentiles():
        rows = physics.g_diagnostic(df).orderBy("LapNumber").collect()
        return [x for r in rows for x in (r["median_g"], r["p90_g"], r["p90_raw"])]

    for module in (track, quality, lap_ops):
        monkeypatch.setattr(module, "PIECE_M", 1e9)
    whole, whole_percentiles = results(), percentiles()
    monkeypatch.setattr(ordered, "STRETCH", 10)
    for module in (track, quality, lap_ops):
        monkeypatch.setattr(module, "PIECE_M", 7.0)
    assert results() == whole
    assert percentiles() == pytest.approx(whole_percentiles)


def test_cut_laps_integrate_the_same_distance(spark, monkeypatch):
    rng = random.Random(2)
    clock, rows = 0.0, []
    for _ in range(400):
        clock += rng.choice([0.2, 0.25, 3.0])
        rows.append((2024, "gp", "A", 1, clock, float(rng.randrange(50, 300))))
    df = spark.createDataFrame(
        rows, "Year int, GrandPrix string, Driver string, LapNumber int, SessionTime double, Speed double"
    )

    def driven():
        found = preparation.lap_distance(df).orderBy("SessionTime").collect()
        return [r["Distance"] for r in found]

    whole = driven()
    wanted, total = [], 0.0
    for i, row in enumerate(rows):
        total += row[5] / 3.6 * (row[4] - rows[i - 1][4]) if i else 0.0
        wanted.append(total)
    assert whole == pytest.approx(wanted)
    monkeypatch.setattr(preparation, "PIECE_S", 1.0)
    assert driven() == pytest.approx(wanted)

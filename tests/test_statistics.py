"""Sketches per race: merged figures against exact ones, and refreshes that touch one race."""

import random

from pyspark.sql import functions as F

from stintlake.operators import pace, statistics

KINDS = "Year int, GrandPrix string, Driver string, LapTime double"


def made(seed, races=3, laps=4000):
    pick = random.Random(seed)
    return [
        (2024 + r % 2, f"gp_{r}", f"D{pick.randint(0, 400)}", None if pick.random() < 0.02 else round(pick.gauss(90 + r, 4), 3))
        for r in range(races) for _ in range(laps)
    ]


def test_merged_figures_are_as_near_as_stated(spark):
    rows = made(1)
    sketches = statistics.race_sketches(spark.createDataFrame(rows, KINDS).repartition(7))
    r = statistics.figures(statistics.merged(sketches, []), []).first()
    times = sorted(t for *_, t in rows if t is not None)
    assert (r["laps"], r["timed"]) == (len(rows), len(times))
    assert (r["fastest"], r["slowest"]) == (times[0], times[-1])
    assert abs(r["mean_time"] - sum(times) / len(times)) < 1e-6
    for name, share in statistics.QUANTILES.items():
        below, upto = sum(t < r[name] for t in times), sum(t <= r[name] for t in times)
        room = statistics.RANK_ERROR * len(times) + 1
        assert below - room <= share * len(times) <= upto + room
    drivers = len({d for _, _, d, _ in rows})
    assert abs(r["drivers"] - drivers) <= statistics.DISTINCT_ERROR * drivers


def test_a_refresh_touches_its_race_alone(spark, tmp_path):
    root = str(tmp_path)
    laps = spark.createDataFrame(made(2), KINDS)
    statistics.store_sketches(statistics.race_sketches(laps), root)
    before = statistics.stored_files(spark, root)
    others = laps.where("GrandPrix <> 'gp_1'").withColumn("LapTime", F.raise_error(F.lit("read")).cast("double"))
    faster = laps.where("GrandPrix = 'gp_1'").withColumn("LapTime", F.col("LapTime") - 10)
    statistics.refresh(faster.unionByName(others), root, [(2025, "gp_1")])
    after = statistics.stored_files(spark, root)
    assert len(after) == len(before) == 3 and len(set(after) & set(before)) == 2
    stored = statistics.read_sketches(spark, root)
    found = {r["GrandPrix"]: r for r in statistics.figures(stored, ["GrandPrix"]).collect()}
    assert found["gp_1"]["median"] < 85 < found["gp_0"]["median"]


def test_odd_tables(spark):
    rows = [(2024, "x", None, None), (None, None, "A", 5.0)]
    figures = statistics.figures(statistics.race_sketches(spark.createDataFrame(rows, KINDS)), ["GrandPrix"])
    found = {r["GrandPrix"]: r for r in figures.collect()}
    assert (found["x"]["laps"], found["x"]["timed"], found["x"]["median"], found["x"]["mean_time"]) == (1, 0, None, None)
    assert found[None]["median"] == 5.0
    empty = statistics.race_sketches(spark.createDataFrame([], KINDS))
    assert statistics.figures(statistics.merged(empty, ["Year"]), ["Year"]).count() == 0


def test_cube_answers_every_filter(spark):
    pick = random.Random(3)
    rows = [
        (pick.choice(["SOFT", "HARD", None]), pick.choice(["2024", "2025"]), pick.choice("ab"), pick.randint(1, 6),
         pick.randint(1, 5), round(pick.uniform(80, 99), 3), pick.choice([None, round(pick.uniform(0, 4), 3)]))
        for _ in range(600)
    ]
    laps = spark.createDataFrame(
        rows, "Compound string, Temporada string, Circuito string, LapNumber int, TyreLife int, LapTime double, DeltaRitmo double"
    )
    cube = pace.bi_cube(pace.bi_partials(laps)).persist()
    for filters in ({}, {"Compound": "SOFT"}, {"Temporada": ["2024", "2025"], "Circuito": "a"},
                    {"Compound": ["SOFT", "HARD"], "Temporada": "2025", "Circuito": ["a", "b"]}):
        for axis, plain, name in (("LapNumber", pace.bi_lap_curve, "mean_lap_time"), ("TyreLife", pace.bi_wear_curve, "mean_delta")):
            wanted = {r[axis]: (r["laps"], round(r[name], 6)) for r in plain(laps, **filters).collect()}
            found = {r[axis]: (r["laps"], round(r[name], 6)) for r in pace.bi_answer(cube, axis, **filters).collect()}
            assert found == wanted
    cube.unpersist()

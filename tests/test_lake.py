import json
import os

import pytest
from pyspark.sql import functions as F

from stintlake import schemas
from stintlake.operators import catalogue, quality, wear_model
from stintlake.plans import builds, fixtures
from stintlake.sources import readers, writers
from stintlake.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def bronze_laps(spark, race, rows, year=2024):
    made = [
        (d, "T1", float(n), 1.0, "SOFT", float(n), t, 1.0, 2.0, 3.0, year, race) for d, n, t in rows
    ]
    return spark.createDataFrame(made, schemas.BRONZE_LAPS)


def bronze_telemetry(spark, race, drivers, year=2024, laps=3, samples=25):
    made = [
        (d, "T1", n, "SOFT", float(k), k * 10.0, 100.0 if k else 0.0, 11000, 7, 90, k % 2 == 0, 12,
         k * 100, n, "", 5.0, year, race)
        for d in drivers for n in range(0, laps + 1) for k in range(samples)
    ]
    return spark.createDataFrame(made, schemas.BRONZE_TELEMETRY)


def drop(df, root, race, kind, year=2024, part=""):
    df.write.mode("overwrite").parquet(f"{root}/{year}/{race}/R_{kind}{part}.parquet")


@pytest.fixture
def lake(spark, tmp_path):
    bronze, silver = str(tmp_path / "raw"), str(tmp_path / "silver")
    for race in ("monza", "são_paulo_grand_prix"):
        drop(bronze_laps(spark, race, [("AAA", 1, 90.5), ("AAA", 2, None), ("BBB", 1, 91.0)]),
             bronze, race, "laps")
        drop(bronze_telemetry(spark, race, ["AAA", "BBB", "CCC"]), bronze, race, "telemetry")
    messages = spark.createDataFrame(
        [("t", "Flag", "m", "", "RED", "", "", "", 3, 2024, "monza")], schemas.BRONZE_EVENTS
    )
    drop(messages, bronze, "monza", "events")
    rows = builds.build_silver(spark, bronze, silver, 2024)
    return bronze, silver, rows


def test_rows_are_counted_during_the_write(lake):
    assert lake[2] == {"laps": 4, "events": 1, "telemetry": 2 * 3 * 3 * 24}


def test_silver_schema_and_types(spark, lake):
    laps = readers.read_silver(spark, lake[1], "laps")
    assert laps.schema.simpleString() == schemas.SILVER_LAPS.simpleString()
    telemetry = readers.read_silver(spark, lake[1], "telemetry")
    assert telemetry.schema.simpleString() == schemas.SILVER_TELEMETRY.simpleString()
    assert telemetry.agg(F.min("Speed"), F.min("LapNumber")).first() == (100.0, 1)
    assert {r["GrandPrix"] for r in laps.select("GrandPrix").distinct().collect()} == {
        "monza", "são_paulo_grand_prix",
    }


def test_one_file_per_driver_folder(spark, lake):
    files = quality.partition_files(
        readers.read_silver(spark, lake[1], "telemetry"), ["Year", "GrandPrix", "Driver"]
    ).collect()
    assert len(files) == 6
    assert {r["files"] for r in files} == {1}
    assert all(r["bytes"] > 0 for r in files)


def test_large_folders_get_several_files(spark, lake, tmp_path):
    telemetry = readers.read_silver(spark, lake[1], "telemetry")
    other = str(tmp_path / "split")
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(advisory)
    spark.conf.set(advisory, "200b")
    try:
        many = spark.range(0, 60, 1, 6).crossJoin(F.broadcast(telemetry)).drop("id")
        writers.write_silver(many, other, "telemetry")
    finally:
        spark.conf.set(advisory, was)
    again = readers.read_silver(spark, other, "telemetry")
    files = quality.partition_files(again, ["Year", "GrandPrix", "Driver"]).collect()
    assert max(r["files"] for r in files) > 1
    assert again.count() == 60 * telemetry.count()
    assert again.distinct().exceptAll(telemetry.distinct()).isEmpty()


def test_rebuilt_races_lose_what_they_no_longer_have(spark, lake):
    bronze, silver, _ = lake
    drop(bronze_telemetry(spark, "monza", ["AAA"]), bronze, "monza", "telemetry")
    drop(bronze_laps(spark, "monza", [("AAA", 1, None)]), bronze, "monza", "laps")
    builds.build_silver(spark, bronze, silver, 2024, ["monza"])
    telemetry = readers.read_silver(spark, silver, "telemetry").select("GrandPrix", "Driver")
    assert {tuple(r) for r in telemetry.distinct().collect()} == {
        ("monza", "AAA"), *(("são_paulo_grand_prix", d) for d in ("AAA", "BBB", "CCC")),
    }
    laps = readers.read_silver(spark, silver, "laps")
    assert {r["GrandPrix"] for r in laps.collect()} == {"são_paulo_grand_prix"}


def test_odd_races_are_cast_or_left_out(spark, tmp_path):
    bronze, silver = str(tmp_path / "raw"), str(tmp_path / "silver")
    good = [("AAA", 1, 90.0)]
    drop(bronze_laps(spark, "monza", good), bronze, "monza", "laps")
    whole_numbers = bronze_laps(spark, "spa", good).withColumn("Stint", F.col("Stint").cast("long"))
    drop(whole_numbers, bronze, "spa", "laps")
    drop(bronze_laps(spark, "imola", good).drop("LapTime"), bronze, "imola", "laps")
    text = bronze_laps(spark, "baku", good).withColumn("LapTime", F.lit("1:30"))
    drop(text, bronze, "baku", "laps")
    assert builds.build_silver(spark, bronze, silver, 2024) == {"laps": 2}
    laps = readers.read_silver(spark, silver, "laps")
    assert {r["GrandPrix"] for r in laps.collect()} == {"monza", "spa"}
    _, races, rejected = readers.read_valid_bronze(spark, bronze, 2024)
    assert races == {(2024, "monza"), (2024, "spa")} and len(rejected) == 2


def test_rewriting_one_race_leaves_the_other(spark, lake):
    bronze, silver, _ = lake
    drop(bronze_laps(spark, "monza", [("ZZZ", 1, 80.0)]), bronze, "monza", "laps")
    builds.build_silver(spark, bronze, silver, 2024, ["Monza"])
    laps = readers.read_silver(spark, silver, "laps")
    drivers = {(r["GrandPrix"], r["Driver"]) for r in laps.collect()}
    assert drivers == {
        ("monza", "ZZZ"), ("são_paulo_grand_prix", "AAA"), ("são_paulo_grand_prix", "BBB"),
    }


def test_missing_bronze_is_skipped(spark, lake, tmp_path):
    assert builds.build_silver(spark, lake[0], str(tmp_path / "none"), 2031) == {}


def test_driver_read_prunes_folders_and_columns(spark, lake):
    driver = readers.read_driver(spark, lake[1], 2024, "monza", "aaa")
    assert driver.count() == 72
    plan = driver._jdf.queryExecution().executedPlan().toString()
    assert "Driver" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "DriverAhead" not in plan.split("ReadSchema")[1]


def test_missing_and_empty_folders_differ(spark, lake):
    silver = lake[1]
    assert readers.driver_state(spark, silver, 2024, "monza", "AAA") == "data"
    assert readers.driver_state(spark, silver, 2024, "monza", "XXX") == "missing"
    folder = f"{silver}/telemetry/Year=2024/GrandPrix=monza/Driver=EEE"
    inner = readers.read_silver(spark, silver, "telemetry").drop("Year", "GrandPrix", "Driver")
    inner.limit(0).write.parquet(folder)
    assert readers.driver_state(spark, silver, 2024, "monza", "EEE") == "empty"


def test_gold_documents(spark, lake, tmp_path):
    calendar = spark.createDataFrame(
        [(2024, 2, "Monza", "2024-09-01"), (2024, 1, "São Paulo Grand Prix", "2024-03-01"),
         (2024, 3, "Qatar Grand Prix", "2024-12-01")],
        "Year int, RoundNumber int, EventName string, EventDate string",
    ).withColumn("EventDate", F.to_date("EventDate"))
    results = spark.createDataFrame(
        [(2024, "monza", "AAA", "Ana Ávila Ruiz"), (2024, "monza", "BBB", "")],
        "Year int, GrandPrix string, Abbreviation string, FullName string",
    )
    path = str(tmp_path / "catalogue")
    builds.build_catalogue(spark, lake[1], calendar, results, "2024-10-01", path)
    text = "".join(
        open(os.path.join(path, "circuitos", f), encoding="utf-8").read()
        for f in os.listdir(os.path.join(path, "circuitos")) if f.startswith("part-")
    )
    races = [json.loads(line) for line in text.splitlines()]
    assert [r["ronda"] for r in races] == [1, 2, 3]
    assert races[0]["nombre"] == "São Paulo" and "São" in text
    assert races[1]["pilotos"][0] == {"code": "AAA", "team": "T1", "name": "Ana Ávila Ruiz"}
    assert races[1]["pilotos"][2] == {"code": "CCC", "team": "Sin equipo", "name": "CCC"}
    assert (races[2]["tiene_datos"], races[2]["pilotos"], races[2]["vueltas"]) == (False, [], None)
    nested = str(tmp_path / "catalogo.json")
    with open(nested, "w", encoding="utf-8") as f:
        json.dump({"years": [2024], "circuitos": races}, f, indent=2, ensure_ascii=False)
    read = readers.read_document(spark, nested, "circuitos")
    assert read.count() == 3
    again = readers.read_gold(spark, path, "circuitos")
    assert again.exceptAll(read).isEmpty() and again.count() == 3
    teams = {r["equipo"] for r in readers.read_gold(spark, path, "equipos").collect()}
    assert teams == {"T1", "Sin equipo"}
    assert [r["year"] for r in readers.read_gold(spark, path, "years").collect()] == [2024]
    with pytest.raises(Exception, match="predicciones"):
        readers.read_document(spark, nested, "predicciones").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_gold(spark, path, "predicciones").collect()
    assert catalogue.catalogue_summary(read).first()["with_data"] == 2


def test_predictions_document(spark, tmp_path):
    row = {"year": 2024, "gp": "monza", "driver": "AAA", "pit_window": None, "pit_real": 20}
    path = str(tmp_path / "predicciones.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"predicciones_totales": 1, "predicciones": [row]}, f, indent=2)
    read = readers.read_document(spark, path, "predicciones").first()
    assert (read["driver"], read["pit_window"], read["pit_real"]) == ("AAA", None, 20)


def test_report_documents(spark, tmp_path):
    folder = tmp_path / "2024" / "monza"
    folder.mkdir(parents=True)
    (folder / "R_report.json").write_text(
        json.dumps({"gp": "monza", "year": 2024, "pilotos": 18, "faltantes": ["ALB"]}, indent=2)
    )
    report = readers.read_reports(spark, str(tmp_path), 2024).first()
    assert (report["pilotos"], report["faltantes"]) == (18, ["ALB"])


def test_warehouse_load_replaces_and_skips_empty(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS check_bi")
    try:
        one = spark.createDataFrame([(1,), (2,)], "v int")
        assert writers.load_table(one, "check_bi.t")
        assert writers.load_table(one.where("v = 1"), "check_bi.t")
        assert spark.table("check_bi.t").count() == 1
        assert not writers.load_table(one.where("v > 9"), "check_bi.t")
        assert spark.table("check_bi.t").count() == 1
    finally:
        spark.sql("DROP DATABASE check_bi CASCADE")


def test_model_is_stored_with_its_metrics(spark, tmp_path):
    silver, models = str(tmp_path / "silver"), str(tmp_path / "models")
    writers.write_silver(fixtures.silver_laps(spark, SMALL), silver, "laps")
    years = [1996, 1997, 1998]
    params = wear_model.WearParams(trees=12, rate=0.3)
    builds.train_era(spark, silver, models, years, params=params)
    metrics = writers.read_metrics(spark, models).first()
    assert metrics["era"] == "1996-1997-1998" and list(metrics["years"]) == years
    assert metrics["holdout"] in metrics["circuitos"]
    assert metrics["mae_segundos"] < metrics["baseline_segundos"]
    assert list(metrics["importancias"])[0] in metrics["features"]
    grid = wear_model.prediction_grid(spark, writers.load_model(spark, models, "1996-1997-1998"))
    assert grid.count() == 28800
    path = str(tmp_path / "pred")
    builds.build_predictions(spark, silver, models, years, path, None)
    rows = readers.read_gold(spark, path, "predicciones")
    assert rows.where("pit_window IS NOT NULL").count() > 0
    assert {r["year"] for r in rows.select("year").distinct().collect()} <= set(years)
    merged = str(tmp_path / "pred2")
    builds.build_predictions(spark, silver, models, years, merged, path)
    assert readers.read_gold(spark, merged, "predicciones").count() == rows.count()


def test_stream_equals_batch(spark, tmp_path):
    bronze, checkpoint = str(tmp_path / "raw"), str(tmp_path / "seen")
    streamed, batch = str(tmp_path / "streamed"), str(tmp_path / "batch")

    def refresh():
        query = incremental.refresh_silver(spark, bronze, streamed, checkpoint)
        query.awaitTermination()
        assert query.exception() is None

    def rows(root):
        return sorted(map(str, readers.read_silver(spark, root, "laps").collect()))

    drop(bronze_laps(spark, "monza", [("AAA", 1, 90.0), ("AAA", 2, None)]), bronze, "monza", "laps")
    drop(bronze_laps(spark, "spa", [("BBB", 1, 100.0)]), bronze, "spa", "laps")
    refresh()
    assert len(rows(streamed)) == 2
    # The second half of a race arrives later: the first half must survive.
    drop(bronze_laps(spark, "monza", [("CCC", 1, 89.0)]), bronze, "monza", "laps", part="_2")
    drop(bronze_laps(spark, "imola", [("AAA", 1, 80.0)], 2025), bronze, "imola", "laps", 2025)
    refresh()
    refresh()
    builds.build_silver(spark, bronze, batch, 2024)
    builds.build_silver(spark, bronze, batch, 2025)
    assert rows(streamed) == rows(batch)
    assert len(rows(streamed)) == 4


@pytest.mark.parametrize("kind", ["telemetry", "events"])
def test_stream_of_other_tables_equals_batch(spark, tmp_path, kind):
    bronze, streamed, batch = (str(tmp_path / x) for x in ("raw", "streamed", "batch"))

    def arrive(race, drivers):
        if kind == "telemetry":
            drop(bronze_telemetry(spark, race, drivers), bronze, race, kind)
        else:
            rows = [("t", "Flag", d, "", "RED", "", "", "", 3, 2024, race) for d in drivers]
            drop(spark.createDataFrame(rows, schemas.BRONZE_EVENTS), bronze, race, kind)

    def refresh():
        incremental.refresh_silver(
            spark, bronze, streamed, str(tmp_path / "seen"), kind
        ).awaitTermination()

    arrive("monza", ["AAA", "BBB"])
    arrive("spa", ["CCC"])
    refresh()
    arrive("monza", ["BBB"])  # the race again, one driver fewer
    arrive("imola", ["DDD"])
    refresh()
    builds.build_silver(spark, bronze, batch, 2024)
    one, two = (readers.read_silver(spark, root, kind) for root in (streamed, batch))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.select("GrandPrix").distinct().count() == 3

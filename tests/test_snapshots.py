"""Publishing: whatever step a write dies at, readers see the old state or the new one."""

import pytest

from stintlake import schemas
from stintlake.sources import folders, readers, snapshots, writers


def laps(spark, rows):
    if not rows:
        return laps(spark, OLD).limit(0)
    made = [
        (d, "T", n, 1, "SOFT", n, t, 1.0, 2.0, 3.0, 2024, race) for race, d, n, t in rows
    ]
    names = "Driver,Team,LapNumber,Stint,Compound,TyreLife,LapTime,Sector1Time,Sector2Time,Sector3Time,Year,GrandPrix"
    df = spark.createDataFrame(made, names.split(","))
    fields = {f.name: f.dataType for f in schemas.SILVER["laps"]}
    return df.select(*[df[n].cast(t).alias(n) for n, t in fields.items()])


def seen(spark, root, version=None):
    rows = readers.read_silver(spark, root, "laps", version).collect()
    return sorted((r["GrandPrix"], r["Driver"], r["LapNumber"]) for r in rows)


OLD = [("monza", "AAA", 1, 90.0), ("monza", "BBB", 1, 91.0), ("spa", "AAA", 1, 99.0)]
NEW = [("monza", "CCC", 1, 80.0), ("baku", "DDD", 1, 85.0)]
BEFORE = [("monza", "AAA", 1), ("monza", "BBB", 1), ("spa", "AAA", 1)]
AFTER = [("baku", "DDD", 1), ("monza", "CCC", 1), ("spa", "AAA", 1)]
RACES = {(2024, "monza"), (2024, "baku")}


@pytest.fixture
def root(spark, tmp_path):
    writers.write_silver(laps(spark, OLD), str(tmp_path), "laps")
    return str(tmp_path)


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["listed", "write_text", "rename_new", "after"])
def test_a_crash_leaves_the_old_or_the_new_state(spark, root, monkeypatch, step):
    held = readers.read_silver(spark, root, "laps")
    real = {name: getattr(folders, name) for name in ("listed", "write_text", "rename_new")}

    def dying(name):
        def run(*given):
            if name == step:
                raise Died(name)
            real[name](*given) if name != "listed" else None
            if step == "after" and name == "rename_new":
                raise Died("after")
            return real[name](*given) if name == "listed" else None
        return run

    with monkeypatch.context() as patch:
        for name in real:
            patch.setattr(folders, name, dying(name))
        with pytest.raises(Died):
            writers.write_silver(laps(spark, NEW), root, "laps", RACES)
    assert seen(spark, root) == (AFTER if step == "after" else BEFORE)
    assert len(held.collect()) == 3  # who read before goes on reading that state
    writers.write_silver(laps(spark, NEW), root, "laps", RACES)
    assert seen(spark, root) == AFTER
    assert seen(spark, root, 1) == BEFORE


def test_a_write_that_fails_half_way_is_invisible(spark, root):
    from pyspark.sql import functions as F

    bad = laps(spark, NEW * 50).withColumn(
        "LapTime", F.when(F.col("Driver") == "DDD", F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0)
    )
    with pytest.raises(Exception, match="lost"):
        writers.write_silver(bad, root, "laps", RACES)
    assert seen(spark, root) == BEFORE and snapshots.versions(spark, root, "laps") == [1]


def test_writers_at_once_keep_each_others_races(spark, root, monkeypatch):
    real = snapshots._add

    def late(spark_, table, number, entries):
        monkeypatch.setattr(snapshots, "_add", real)  # another writer gets in first
        writers.write_silver(laps(spark, [("imola", "EEE", 1, 70.0)]), root, "laps")
        real(spark_, table, number, entries)

    monkeypatch.setattr(snapshots, "_add", late)
    writers.write_silver(laps(spark, NEW), root, "laps", RACES)
    assert seen(spark, root) == sorted([*AFTER, ("imola", "EEE", 1)])
    assert snapshots.versions(spark, root, "laps") == [1, 2, 3]


def test_plain_folders_are_taken_over(spark, tmp_path):
    root = str(tmp_path)
    laps(spark, OLD).write.partitionBy("Year", "GrandPrix").parquet(f"{root}/laps")
    assert seen(spark, root) == BEFORE
    writers.write_silver(laps(spark, NEW), root, "laps", RACES)
    assert seen(spark, root) == AFTER
    assert readers.read_silver(spark, root, "laps").schema == schemas.SILVER["laps"]


def test_vacuum_keeps_the_last_states(spark, root):
    for k in range(3):
        writers.write_silver(laps(spark, [("monza", "AAA", k, 90.0)]), root, "laps")
    writers.write_silver(laps(spark, []), root, "laps", {(2024, "spa")})
    gone = snapshots.vacuum(spark, root, "laps", keep=2)
    assert len(gone) == 3 and snapshots.versions(spark, root, "laps") == [4, 5]
    assert seen(spark, root) == [("monza", "AAA", 2)]
    assert seen(spark, root, 4) == [("monza", "AAA", 2), ("spa", "AAA", 1)]
    writers.write_silver(laps(spark, []), root, "laps", {(2024, "monza")})
    assert seen(spark, root) == [] and readers.read_silver(spark, root, "laps").schema == schemas.SILVER["laps"]


def test_warehouse_tables_change_in_one_step(spark, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS check_steps")
    try:
        one, two = spark.range(3), spark.range(5)
        one.write.saveAsTable("check_steps.t")  # a plain table from before
        assert writers.load_table(one, "check_steps.t")
        real = spark.sql
        for step in ("CREATE OR REPLACE", "SHOW TABLES", "DROP TABLE"):
            def dying(text, *more, step=step):
                if text.startswith(step):
                    raise Died(step)
                return real(text, *more)

            before = spark.table("check_steps.t").count()
            monkeypatch.setattr(spark, "sql", dying)
            try:
                writers.load_table(two if before == 3 else one, "check_steps.t")
            except Died:
                pass
            monkeypatch.setattr(spark, "sql", real)
            assert spark.table("check_steps.t").count() in (3, 5)
        assert writers.load_table(two, "check_steps.t")
        assert spark.table("check_steps.t").count() == 5
        kept = [r["tableName"] for r in spark.sql("SHOW TABLES IN check_steps LIKE 't__*'").collect()]
        assert len(kept) == 2
    finally:
        spark.sql("DROP DATABASE check_steps CASCADE")


def test_folders_are_listed_in_one_call(spark, tmp_path, monkeypatch):
    """Not with calls for each, of which a lake with a folder per driver would need thousands."""
    names = sorted(["Driver=a, b", "Driver=c%2Fd", "Driver=ñ", *[f"Driver=D{n}" for n in range(500)]])
    for name in names:
        (tmp_path / name).mkdir()
    client, calls = type(spark.sparkContext._gateway._gateway_client), []
    plain = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or plain(*a, **k))
    found = folders.listed(spark, f"{tmp_path}/Driver=*")
    assert len(calls) < 200
    assert sorted(path.rsplit("/", 1)[1] for path in found) == names and found == sorted(found)
    assert folders.listed(spark, f"{tmp_path}/Team=*") == folders.listed(spark, f"{tmp_path}/none") == []

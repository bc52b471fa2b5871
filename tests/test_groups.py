import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlake.functions import ordered
from stintlake.functions.groups import exact_quantiles, exact_ranks, number_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, another has one value only."""
    rng = random.Random(1)
    rows = [("hot", rng.randrange(40), rng.randrange(10**6)) for _ in range(3000)]
    rows += [(f"g{rng.randrange(60)}", rng.randrange(40), rng.randrange(10**6)) for _ in range(5900)]
    rows += [("same", 5, 77)] * 100
    rows = [(*row, i) for i, row in enumerate(rows)]
    return spark.createDataFrame(rows, "g string, bucket int, v int, id int"), rows


def test_positions_equal_a_plain_sort(spark, skewed):
    df, rows = skewed
    ours = number_rows(df, ["g"], "bucket", ["v", "id"], "n").collect()
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        groups.setdefault(row[0], []).append(row[3])
    wanted = {i: n for ids in groups.values() for n, i in enumerate(ids, 1)}
    assert {r["id"]: r["n"] for r in ours} == wanted


@pytest.mark.parametrize("width", [0.5, 3.0, 1e9])
def test_ordered_steps_equal_plain_windows(spark, width):
    """Nulls, negative values, ties and a key that is null, whatever the width of the pieces."""
    rng = random.Random(2)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice([None, -7.5, 0.0, 4.25, rng.uniform(-9, 9)]), i)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "g string, x double, id long")
    cut = ordered.cut(df, ordered.bucket("x", width))
    steps = ordered.previous(cut, ["g"], ["x", "id"], ["x", "id"], "before")
    summed = ordered.running_sum(steps, ["g"], ["x", "id"], total=F.col("id"))
    whole = ordered.group_values(summed, ["g"], most=F.max("id"))
    window = Window.partitionBy("g").orderBy("x", "id")
    plain = (
        df.withColumn("before", F.lag(F.struct("x", "id")).over(window))
        .withColumn("total", F.sum("id").over(window))
        .withColumn("most", F.max("id").over(Window.partitionBy("g")))
    )
    found, wanted = (sorted(map(repr, f.select(*plain.columns).collect())) for f in (whole, plain))
    assert found == wanted


def test_building_a_plan_starts_no_job(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "g string, x double, id long")
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "")
    cut = ordered.cut(df, ordered.bucket("x", 1.0))
    ordered.running_sum(ordered.previous(cut, ["g"], ["x"], ["x"], "p"), ["g"], ["x"], s=F.lit(1))
    number_rows(cut, ["g"], "_piece", ["x"], "n")
    assert not status.getJobIdsForGroup("plans")
    spark.sparkContext.setJobGroup("", "")


def test_rows_to_number_are_joined_with_nothing(spark, skewed, capsys):
    number_rows(skewed[0], ["g"], "bucket", ["v", "id"], "n").explain()
    assert "Join" not in capsys.readouterr().out


def test_numbered_rows_get_what_is_known_of_their_group(spark):
    """Null keys and pieces are groups of their own; rows that nothing is known of are left out."""
    rows = [("a", 1, 5), ("a", 1, 4), ("a", 2, 3), ("b", 1, 2), (None, 1, 1), ("a", None, 9)]
    df = spark.createDataFrame(rows, "g string, piece int, v int")
    plain = number_rows(df, ["g"], "piece", ["v"], "n").collect()
    assert {(r.g, r.v): r.n for r in plain} == {
        ("a", 9): 1, ("a", 4): 2, ("a", 5): 3, ("a", 3): 4, ("b", 2): 1, (None, 1): 1
    }
    known = spark.createDataFrame([("a", [7, 8]), ("c", [1]), (None, [2])], "g string, x array<int>")
    found = number_rows(df, ["g"], "piece", ["v"], "n", known)
    assert found.columns == [*df.columns, "n", "x"]
    assert {(r.g, r.v): (r.n, tuple(r.x)) for r in found.collect()} == {
        ("a", v): (n, (7, 8)) for n, v in enumerate([9, 4, 5, 3], 1)
    }


@pytest.mark.parametrize("width", [0.5, 1000.0, 1e9])
def test_quantiles_are_exact(spark, skewed, width):
    df, rows = skewed
    found = exact_quantiles(
        df.withColumn("x", F.col("v") / 8.0), ["g"], "x", {"mid": 0.5, "p90": 0.9}, width
    ).collect()
    for row in found:
        values = [r[2] / 8.0 for r in rows if r[0] == row["g"]]
        assert row["mid"] == statistics.median(values)
        assert row["p90"] == pytest.approx(np.quantile(values, 0.9), abs=1e-6)
    assert len(found) == len({r[0] for r in rows})


def test_ranks_pick_the_middle(spark):
    df = spark.createDataFrame([("a", n) for n in (9, 3, 700, 5)] + [("b", 4)], "g string, n int")
    found = exact_ranks(df, ["g"], "n", {"mid": lambda n: F.floor(n / 2)}, 2.0).collect()
    assert {r["g"]: r["mid"] for r in found} == {"a": 9, "b": 4}

"""Boosted trees from cells against trees grown row by row in plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintlake.operators import boosting, wear_model
from stintlake.sources import writers

FEATURES = ["TyreLife", "LapNumber", "Stint", "Compound_SOFT", "Compound_HARD"]
KINDS = "era string, n int, TyreLife int, LapNumber int, Stint int, Compound_SOFT int, Compound_HARD int, y double"


def made_rows(seed, n=500, eras=("a", "b")):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        tyre, lap, stint, soft = pick.randint(1, 30), pick.randint(1, 60), pick.randint(1, 3), pick.randint(0, 1)
        y = round(0.08 * tyre - 0.01 * lap + soft * tyre * 0.05 + pick.random(), 3)
        rows.append((pick.choice(eras), i, tyre, lap, stint, soft, 1 - soft, y))
    return rows


def share(row, seed):
    digest = hashlib.md5(f"share|{seed}|{row[0]}|{row[1]}".encode()).hexdigest()
    return int(digest[:8], 16) % boosting.SHARES


def plain(rows, params):
    """Nodes {(tree, node): (feature, threshold, rows, value)} and the predictions of the rows."""
    ys = [r[-1] for r in rows]
    mean = sum(ys) / len(ys)
    out = {(0, 1): (None, None, len(rows), mean)}
    predicted = [mean] * len(rows)
    for tree in range(1, params.trees + 1):
        rng = np.random.default_rng([params.seed, tree])
        shares = set(rng.permutation(boosting.SHARES)[: max(1, round(params.row_share * boosting.SHARES))].tolist())
        columns = sorted(rng.permutation(len(FEATURES))[: max(1, int(params.column_share * len(FEATURES)))].tolist())
        drawn = [share(r, params.seed) in shares for r in rows]

        def sums(members):
            mine = [i for i in members if drawn[i]]
            return sum(predicted[i] - ys[i] for i in mine), len(mine)

        change = {}

        def grow(node, members, depth):
            g, h = sums(members)
            best = (boosting.LEAST_GAIN, None, None)
            if depth < params.depth:
                for j in columns:
                    values = sorted({rows[i][2 + j] for i in members})
                    for threshold in range(0, max(values)):
                        left = [i for i in members if rows[i][2 + j] <= threshold]
                        lg, lh = sums(left)
                        rg, rh = g - lg, h - lh
                        if lh < params.least_rows or rh < params.least_rows:
                            continue
                        gain = lg**2 / (lh + params.l2) + rg**2 / (rh + params.l2) - g**2 / (h + params.l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, threshold)
            _, j, threshold = best
            if j is None:
                value = -params.rate * g / (h + params.l2)
                out[tree, node] = (None, None, h, value)
                change.update(dict.fromkeys(members, value))
                return
            out[tree, node] = (FEATURES[j], threshold, h, 0.0)
            grow(2 * node, [i for i in members if rows[i][2 + j] <= threshold], depth + 1)
            grow(2 * node + 1, [i for i in members if rows[i][2 + j] > threshold], depth + 1)

        grow(1, list(range(len(rows))), 0)
        predicted = [p + change[i] for i, p in enumerate(predicted)]
    return out, predicted


@pytest.mark.parametrize("params", [
    wear_model.WearParams(trees=6, rate=0.3, depth=3),
    wear_model.WearParams(trees=3, rate=0.5, depth=4, row_share=1.0, column_share=1.0, l2=0.0, least_rows=9, seed=7),
])
def test_equals_trees_grown_row_by_row(spark, params):
    rows = made_rows(3, 300)
    df = spark.createDataFrame(rows, KINDS)
    cells = boosting.cells(df.repartition(5), FEATURES, "y", ["era"], ["era", "n"], params.seed)
    model = boosting.BoostedTrees(boosting.fit(cells, FEATURES, ["era"], params), ["era"])
    predicted = {r["n"]: r["prediction"] for r in model.transform(df).collect()}
    for era in "ab":
        mine = [r for r in rows if r[0] == era]
        wanted, scores = plain(mine, params)
        found = {
            (r.tree, r.node): (r.feature, r.threshold, r.rows, r.value)
            for r in model.trees.where(F.col("era") == era).collect()
        }
        assert found.keys() == wanted.keys()
        for at, (feature, threshold, count, value) in wanted.items():
            assert found[at][:3] == (feature, threshold, count)
            assert found[at][3] == pytest.approx(value, abs=1e-9)
        assert [predicted[r[1]] for r in mine] == pytest.approx(scores, abs=1e-9)


def test_trees_do_not_depend_on_partitioning_or_copies_of_cells(spark, tmp_path):
    df = spark.createDataFrame(made_rows(4), KINDS)
    params = wear_model.WearParams(trees=20)

    def trees(rows):
        cells = boosting.cells(rows, FEATURES, "y", ["era"], ["era", "n"], params.seed)
        return boosting.fit(cells, FEATURES, ["era"], params)

    one, two = (sorted(map(str, trees(df.repartition(n)).collect())) for n in (1, 11))
    assert one == two
    model = boosting.BoostedTrees(trees(df), ["era"])
    writers.save_trees(model, str(tmp_path), "a-b")
    again = writers.load_model(spark, str(tmp_path), "a-b")
    assert sorted(map(str, again.trees.collect())) == one
    scored, loaded = (sorted(map(str, m.transform(df).collect())) for m in (model, again))
    assert scored == loaded
    listed = {(r.era, r.feature): r.importance for r in again.importances().collect()}
    assert len(listed) == 2 * len(FEATURES)
    for era in "ab":
        assert sum(x for (e, _), x in listed.items() if e == era) == pytest.approx(1, abs=1e-3)


def test_odd_rows(spark):
    params = wear_model.WearParams(trees=4, rate=0.5)
    rows = made_rows(5, 60, ("a",)) + [
        ("a", 900, None, 1, 1, 0, 1, 1.0), ("a", 901, 1, 1, 1, 0, 1, None),
        ("one", 902, 5, 5, 1, 1, 0, 2.5),  # a single row: the mean, and trees that change nothing
        ("a", 903, 500, -3, 99, 1, 0, 2.0),  # values beyond the listed ones count as the last, or 0
    ]
    df = spark.createDataFrame(rows, KINDS)
    cells = boosting.cells(df, FEATURES, "y", ["era"], ["era", "n"])
    assert cells.agg(F.sum("rows")).first()[0] == 62
    assert cells.where("TyreLife = 63 AND LapNumber = 0 AND Stint = 7").count() == 1
    model = boosting.BoostedTrees(boosting.fit(cells, FEATURES, ["era"], params), ["era"])
    asked = df.union(spark.createDataFrame([("none", 904, 1, 1, 1, 0, 1, 0.0)], KINDS))
    found = {r["n"]: r["prediction"] for r in model.transform(asked).collect()}
    assert len(found) == len(rows) + 1
    assert found[900] is None and found[904] is None and found[901] is not None
    assert found[902] == pytest.approx(2.5)
    empty = df.limit(0)
    nothing = boosting.fit(boosting.cells(empty, FEATURES, "y", ["era"], ["era", "n"]), FEATURES, ["era"], params)
    assert nothing.count() == 0


def test_lower_error_than_the_mean(spark):
    df = spark.createDataFrame(made_rows(6, 2000, ("a",)), KINDS).withColumn("validation", F.col("n") % 5 == 0)
    cells = boosting.cells(df.where("NOT validation"), FEATURES, "y", ["era"], ["era", "n"])
    model = boosting.BoostedTrees(boosting.fit(cells, FEATURES, ["era"], wear_model.WearParams()), ["era"])
    r = wear_model.evaluate(model, df, "y").first()
    assert r["better"] and r["gain_pct"] > 50 and r["training_laps"] == 1600
    assert 0.2 < r["mae"] < 0.3  # the noise is uniform on 0 to 1: 0.25


def test_laps_do_not_meet_by_race_or_era(spark, capsys):
    """Medians, the names of races, the held-out circuit and the means of eras are a few rows: joined with
    a shuffle, all laps of an era or race would be one task's."""
    from stintlake.operators import pace, wear_model

    laps = spark.range(50).selectExpr(
        "string(id % 2) AS era", "int(2000 + id % 4) AS Year", "string(id % 3) AS GrandPrix", "string(id % 5) AS Driver",
        "int(id) AS LapNumber", "1 AS TyreLife", "1 AS Stint", "80.0D + id AS LapTime",
        "double(id) AS LapTimeDelta",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = wear_model.holdout_split(laps)
        for found in (
            pace.rule_107(laps, ["Year", "GrandPrix"]), pace.fuel_adjust(laps, ["Year", "GrandPrix"]), split,
        ):
            found.explain()
            shown = capsys.readouterr().out
            assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
        assert {(r.era, r.GrandPrix) for r in split.where("validation").collect()} == {("0", "0"), ("1", "1")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

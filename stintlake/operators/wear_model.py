"""The tyre-wear model: eras, training rows, holdout, boosted trees and their error.

Rows carry the column `era`, and every step works on all eras at once: the pace rules compare the
laps of an era, each era keeps a circuit of its own for validation and has trees of its own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.operators import boosting, pace, strategy

NUMERIC = ["TyreLife", "LapNumber", "Stint"]
ERA = ["era"]

WearParams = boosting.TreeParams


def era_name(years: list[int]) -> str:
    return "-".join(str(year) for year in years)


def select_era(laps: DataFrame, years: list[int]) -> DataFrame:
    return laps.where(F.col("Year").isin(*years))


def with_era(laps: DataFrame, eras: list[list[int]]) -> DataFrame:
    """Adds `era`, the name of the seasons that a lap's season is listed with; laps of seasons in
    no list belong to no model and are left out."""
    name = F.lit(None).cast("string")
    for years in eras:
        name = F.when(F.col("Year").isin(*years), era_name(years)).otherwise(name)
    return laps.withColumn("era", name).where(F.col("era").isNotNull())


def training_laps(laps: DataFrame) -> DataFrame:
    """Timed dry laps within 107% of their circuit, with the wear target. With a column `era`, laps
    are compared with those of their era."""
    by = [name for name in ERA if name in laps.columns] + ["GrandPrix"]
    timed = laps.where(F.col("LapTime").isNotNull())
    return pace.pace_delta(pace.rule_107(pace.dry_only(timed), by), by)


def compound_columns(compounds: list[str]) -> list[str]:
    return [f"Compound_{name}" for name in compounds]


def features(laps: DataFrame, compounds: list[str] = K.DRY_COMPOUNDS) -> DataFrame:
    """Adds one 0/1 column per compound, keeping all levels; incomplete rows are dropped."""
    needed = [name for name in [*K.MODEL_FEATURES, K.MODEL_TARGET] if name in laps.columns]
    flags = {
        f"Compound_{name}": (F.col("Compound") == name).cast("int") for name in compounds
    }
    return laps.dropna(subset=needed).withColumns(flags)


def holdout_circuit(df: DataFrame, name: str | None = None) -> DataFrame:
    """The circuit of each era kept for validation: the named one, else the one with most rows
    (ties: the first name)."""
    counts = df.groupBy(*ERA, "GrandPrix").agg(F.count(F.lit(1)).alias("laps"))
    if name is not None:
        return counts.where(F.col("GrandPrix") == name)
    largest = F.min(F.struct((-F.col("laps")).alias("rank"), "GrandPrix", "laps")).alias("_top")
    return counts.groupBy(*ERA).agg(largest).select(*ERA, "_top.GrandPrix", "_top.laps")


def holdout_split(df: DataFrame, name: str | None = None) -> DataFrame:
    """Adds `validation`: true for the rows of the holdout circuit of their era."""
    if name is not None:
        return df.withColumn("validation", F.col("GrandPrix") == name)
    chosen = holdout_circuit(df).select(*ERA, F.col("GrandPrix").alias("_kept"))
    # A row per era: broadcast, as joined by era all rows of one would meet in a task.
    return df.join(F.broadcast(chosen), ERA).withColumn("validation", F.col("GrandPrix") == F.col("_kept")).drop("_kept")


def random_holdout(df: DataFrame, seed: int = 42, share: float = 0.2) -> DataFrame:
    """Adds `validation` for a share of the laps, decided by an MD5 of the lap's key: the same
    lap always falls on the same side, however the data are partitioned and in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *K.LAP))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("validation", place < int(share * 10_000))


def inputs_of(df: DataFrame) -> list[str]:
    """The model's features among the columns."""
    named = NUMERIC + [name for name in df.columns if name.startswith("Compound_")]
    return [name for name in named if name in df.columns]


def wear_cells(df: DataFrame, params: WearParams = WearParams(), target: str = K.MODEL_TARGET) -> DataFrame:
    """What the trees are grown from: number and sum of targets of the rows that agree in era,
    features and sampling share."""
    return boosting.cells(df, inputs_of(df), target, ERA, K.LAP, params.seed)


def train_wear(
    df: DataFrame, params: WearParams = WearParams(), target: str = K.MODEL_TARGET
) -> boosting.BoostedTrees:
    """Boosted trees for each era of the rows made by `features`: one pass over the rows."""
    grown = boosting.fit(wear_cells(df, params, target), inputs_of(df), ERA, params)
    return boosting.BoostedTrees(grown, ERA)


def prediction_grid(spark, model: boosting.BoostedTrees) -> DataFrame:
    """Scores every (compound, stint, tyre, lap) of the grid once for each era of the model."""
    eras = F.explode(F.array(*[F.lit(root.era) for root in model.roots()]))
    cells = strategy.grid_cells(spark).withColumns(
        {
            "era": eras,
            "TyreLife": F.col("tyre"),
            "LapNumber": F.col("lap"),
            "Stint": F.col("stint"),
            **{
                f"Compound_{name}": (F.col("compound") == name).cast("int")
                for name in K.DRY_COMPOUNDS
            },
        }
    )
    return model.transform(cells).select(
        "era", "compound", "stint", "tyre", "lap", F.col("prediction").alias("pred")
    )


def baseline_mae(split: DataFrame, target: str = K.MODEL_TARGET) -> DataFrame:
    """Error on each era's validation rows of always predicting its training mean."""
    return evaluate(None, split, target).select("era", "baseline", "validation_laps", "training_laps")


def evaluate(
    model: boosting.BoostedTrees | None, split: DataFrame, target: str = K.MODEL_TARGET
) -> DataFrame:
    """Error of the model on the validation rows against the training mean, gain in percent,
    and whether the model is of use at all. One row per era."""
    training = ~F.col("validation")
    stats = split.groupBy(*ERA).agg(
        F.avg(F.when(training, F.col(target))).alias("_mean"),
        F.count_if(training).alias("training_laps"),
    )
    scored = split.where(F.col("validation"))
    if model is not None:
        scored = model.transform(scored)
    scored = scored.join(F.broadcast(stats.select(*ERA, "_mean")), ERA)
    predicted = F.col("_mean") if model is None else F.col("prediction")
    errors = scored.groupBy(*ERA).agg(
        F.avg(F.abs(F.col(target) - F.col("_mean"))).alias("baseline"),
        F.avg(F.abs(F.col(target) - predicted)).alias("mae"),
        F.count(F.lit(1)).alias("validation_laps"),
    )
    gain = (F.lit(1.0) - F.col("mae") / F.nullif(F.col("baseline"), F.lit(0.0))) * F.lit(100.0)
    return stats.drop("_mean").join(errors, ERA, "left").select(
        "era", "baseline", "mae", F.coalesce("validation_laps", F.lit(0)).alias("validation_laps"),
        "training_laps", gain.alias("gain_pct"), (F.col("mae") < F.col("baseline")).alias("better"),
    )


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and MAPE in percent, in one pass."""
    error = F.col(y) - F.col(yhat)
    return (
        df.groupBy(*by)
        .agg(
            F.count(error).alias("rows"),
            F.avg(error * error).alias("_square"),
            F.avg(F.abs(error)).alias("mae"),
            F.var_pop(F.when(F.col(yhat).isNotNull(), F.col(y))).alias("_spread"),
            F.avg(F.abs(error) / F.nullif(F.abs(F.col(y)), F.lit(0.0))).alias("_share"),
        )
        .select(
            *by,
            "rows",
            F.sqrt("_square").alias("rmse"),
            "mae",
            (F.lit(1.0) - F.col("_square") / F.nullif(F.col("_spread"), F.lit(0.0))).alias("r2"),
            (F.col("_share") * F.lit(100.0)).alias("mape"),
        )
    )


def metrics_dry(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """The same measures for the rows not on intermediate tyres."""
    return regression_metrics(df.where(F.col("Compound") != "INTERMEDIATE"), y, yhat)


def metrics_record(
    evaluation: DataFrame,
    laps: DataFrame,
    model: boosting.BoostedTrees,
    holdout: str | None,
) -> DataFrame:
    """The metrics record of each era, ready to be written as JSON.

    The lists of circuits and seasons have one entry per circuit and season, not per lap.
    """
    calendar = laps.groupBy(*ERA).agg(
        F.array_sort(F.collect_set("Year")).alias("years"),
        F.array_sort(F.collect_set("GrandPrix")).alias("circuitos"),
    )
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("importance")).alias("rank"), "feature", "importance"))
    )
    entries = F.transform(ranked, lambda x: F.struct(x["feature"], x["importance"]))
    weights = model.importances().groupBy(*ERA).agg(F.map_from_entries(entries).alias("importancias"))
    return evaluation.join(calendar, ERA).join(weights, ERA).select(
        "era",
        "years",
        F.lit(K.TARGET_LABEL).alias("target"),
        C.half_up("mae", 3).alias("mae_segundos"),
        C.half_up("baseline", 3).alias("baseline_segundos"),
        F.col("training_laps").alias("vueltas_entrenamiento"),
        F.col("validation_laps").alias("vueltas_validacion"),
        "circuitos",
        F.lit(holdout).cast("string").alias("holdout"),
        F.array(*[F.lit(name) for name in model.features]).alias("features"),
        "importancias",
    )

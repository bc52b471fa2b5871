"""Writing the lake: partitioned silver tables, gold documents, warehouse tables, models."""

import logging
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stintlake import schemas
from stintlake.operators.boosting import BoostedTrees
from stintlake.sources import snapshots

log = logging.getLogger(__name__)


def write_silver(
    df: DataFrame, root: str, kind: str, races: set[tuple[int, str]] | None = None
) -> Observation:
    """Writes a silver table and publishes it in one step (see `snapshots`), replacing the
    partitions present in `df`; and with `races`, (year, race) pairs that `df` holds as a whole,
    dropping those partitions of theirs that got no rows.

    Rows are dealt to tasks by folder, so a folder gets one file; Spark splits folders above its
    advisory partition size, and those get several. Telemetry is sorted by lap and distance
    inside the file, so row-group statistics help a reader of one lap. The returned observation
    holds the number of rows written, counted during the write.
    """
    partition = schemas.SILVER_PARTITIONS[kind]
    inside = ["LapNumber", "Distance"] if kind == "telemetry" else []
    written, commit = Observation(f"silver_{kind}"), uuid4().hex
    (
        df.hint("rebalance", *partition)
        .sortWithinPartitions(*partition, *inside)
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.partitionBy(*partition)
        .parquet(f"{root}/{kind}/commit={commit}")
    )
    version = snapshots.publish(df.sparkSession, root, kind, commit, races)
    log.info("%s: state %d published", kind, version)
    return written


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """Writes the catalogue as JSON lines, a race with its nested drivers each, with the season
    and team lists beside them; `readers.read_gold` reads them by the same names.

    The rows of a calendar are races, a few dozen per season, so one file holds them.
    """
    lines = catalogue.repartition(1).sortWithinPartitions("year", "ronda")
    _write_lines(lines, f"{path}/circuitos")
    stored = catalogue.sparkSession.read.schema(schemas.GOLD_RACE).json(f"{path}/circuitos")
    _write_lines(stored.select("year").distinct(), f"{path}/years")
    teams = stored.select(F.explode("pilotos.team").alias("equipo")).distinct()
    _write_lines(teams, f"{path}/equipos")


def _write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Writes gold rows as JSON lines, in as many files as there are tasks."""
    _write_lines(df, path)


def load_table(df: DataFrame, name: str) -> bool:
    """Replaces a warehouse table; an empty frame is skipped with a warning.

    The rows are counted while they are written to a table of their own; then the view `name` is
    pointed at it, in one step of the catalogue, so there is always an old or a new table to read.
    The table before stays for readers under way, older ones go. A plain table of that name, from
    before, is replaced by the view once."""
    spark, rows = df.sparkSession, Observation(name)
    version = f"{name}__{uuid4().hex}"
    counted = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    counted.write.saveAsTable(version)
    if not rows.get["rows"]:
        spark.sql(f"DROP TABLE {version}")
        log.warning("%s is empty, skipped", name)
        return False
    before = _version_of(spark, name)
    if before is None and spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('version' = '{version}') AS SELECT * FROM {version}")
    database, _, table = name.rpartition(".")
    inside = f" IN {database}" if database else ""
    for row in spark.sql(f"SHOW TABLES{inside} LIKE '{table}__*'").collect():
        other = f"{database}.{row['tableName']}" if database else row["tableName"]
        if other.lower() not in {version.lower(), (before or "").lower()}:
            spark.sql(f"DROP TABLE IF EXISTS {other}")
    return True


def _version_of(spark: SparkSession, name: str) -> str | None:
    """The table behind a view that `load_table` made; None for anything else."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    shown = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return shown.get("version")


def save_trees(model: BoostedTrees, root: str, era: str) -> None:
    """Stores a model, a table of tree nodes, under the name of its era."""
    model.trees.coalesce(1).write.mode("overwrite").parquet(f"{root}/wear_{era}")


def save_metrics(metrics: DataFrame, root: str, era: str) -> None:
    write_rows(metrics.coalesce(1), f"{root}/metrics_{era}")


def save_model(model: BoostedTrees, metrics: DataFrame, root: str, era: str) -> None:
    """Stores a model and its metrics under the name of its era."""
    save_trees(model, root, era)
    save_metrics(metrics, root, era)


def load_model(spark: SparkSession, root: str, era: str) -> BoostedTrees:
    return BoostedTrees(spark.read.parquet(f"{root}/wear_{era}"), ["era"])


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metrics records of all eras under a folder."""
    return spark.read.schema(schemas.ERA_METRICS).json(f"{root}/metrics_*")

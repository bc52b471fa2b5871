"""Tables derived once and stored in the cluster's shared folder, as the lake's layers are."""

import re
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (a test) gets
    one of its own; on a cluster executors share no local folder, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    session = spark.sparkContext.applicationId
    if session not in _own_folders:
        _own_folders[session] = tempfile.mkdtemp(prefix="stintlake-")
    return _own_folders[session]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder."""
    return f"{shared_folder(spark)}/stintlake/{spark.sparkContext.applicationId}/{uuid4().hex}/{name}"


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where this session keeps what it derives from the tables of a folder."""
    source = re.sub(r"\W+", "_", sf_dir).strip("_")
    return f"{shared_folder(spark)}/stintlake/{spark.sparkContext.applicationId}/{source}/{name}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Names a checkpoint folder in the shared folder, where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Writes the table on first use in a session, then reads it back.

    Queries that use a table several times read columns from files instead of deriving it
    again, and a lost executor costs a re-read, not the whole lineage.
    """
    path = stored_path(spark, sf_dir, name)
    if path not in _written:
        build().write.mode("overwrite").parquet(path)
        _written.add(path)
    return spark.read.parquet(path)

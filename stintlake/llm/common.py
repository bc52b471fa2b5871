"""What several operators of this folder share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (a test) gets
    a folder of its own; a cluster gets an error, since its executors share no local folder."""
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


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: lineage ends there, so a lost
    executor costs a re-read. Every call has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stintlake-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with `value` worked out once, however often body uses it, also in lambdas."""
    return F.transform(F.array(value), body)[0]


def row_key(columns: list[str]) -> Column:
    """128 bits that name a row by all its columns."""
    every = [F.col(c) for c in columns]
    # A null hashes as if it were left out; the mask of nulls keeps such rows apart.
    nulls = F.concat_ws("", *[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.struct(
        F.xxhash64(nulls, *every).alias("a"), F.xxhash64(F.lit(7), nulls, *every).alias("b")
    )


def numbered(docs: DataFrame) -> DataFrame:
    """The frame with its columns named _0, _1, ..., which no column that is added clashes with;
    `toDF` with the old names undoes it."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])

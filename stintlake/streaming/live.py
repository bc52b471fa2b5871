"""Live timing: laps summed up while their samples arrive, late ones included.

Samples are summed to partial laps before the shuffle, so a car with a large share of them doesn't
meet in a task sample by sample. The cars are dealt by hash to shares; a share's state holds the sums
of its cars' laps, and a batch takes one step over it for all of them. A lap is `open` until
the car has driven on for `grace` seconds in a later lap; then it is `closed`, once. Samples that
arrive afterwards give a `corrected` row. Every row of a lap has a higher version than those
before, and the last version of a lap equals the summary of all its samples, in whatever order they
came. A car's laps are forgotten when no sample came within `horizon` of event time; samples
that are later than that are not taken in, and Spark counts them in the query's progress.
"""

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stintlake import constants as K

#: Sums of a lap: what merges two partial sums.
SUMS = {
    "samples": "sum", "first_us": "min", "last_us": "max", "top_speed": "max", "speed_tenths": "sum",
    "full_throttle": "sum", "braking": "sum", "metres": "max",
}
TYPES = {"top_speed": "double", "metres": "double"}
LAP_KINDS = "Year int, GrandPrix string, Driver string, LapNumber int"
SUM_KINDS = ", ".join(f"{name} {TYPES.get(name, 'long')}" for name in SUMS)
ROWS = f"{LAP_KINDS}, {SUM_KINDS}, status string, version int"

#: A lap's status is kept as its place here.
STATUS = ["open", "closed", "corrected"]
OPEN, CLOSED, CORRECTED = range(3)

#: The cars are dealt to so many states; a step takes some 40 ms, over 9 cars as over 84.
SHARES = 1024
#: A lap in the state of its share. `arrived` is 1 only within a step, for laps with new samples.
KEPT = pa.schema(
    [("Year", pa.int32()), ("GrandPrix", pa.string()), ("Driver", pa.string()), ("LapNumber", pa.int32())]
    + [(name, pa.float64() if name in TYPES else pa.int64()) for name in SUMS]
    + [("status", pa.int8()), ("version", pa.int32()), ("until", pa.int64()), ("arrived", pa.int8())]
)

SAMPLES = f"{LAP_KINDS}, ts timestamp, Speed double, Throttle double, Brake int, Distance double"


def measured(samples: DataFrame) -> DataFrame:
    """A row per sample with the values whose sums make a lap. Samples without lap, car or time
    belong to no lap; other missing values count as nothing."""
    return samples.dropna(subset=[*K.LAP, "ts"]).select(
        *K.LAP,
        F.lit(1).cast("long").alias("samples"),
        F.unix_micros("ts").alias("first_us"),
        F.unix_micros("ts").alias("last_us"),
        F.col("Speed").alias("top_speed"),
        F.coalesce(F.round(F.col("Speed") * 10).cast("long"), F.lit(0)).alias("speed_tenths"),
        F.coalesce((F.col("Throttle") >= 99).cast("long"), F.lit(0)).alias("full_throttle"),
        F.coalesce((F.col("Brake") > 0).cast("long"), F.lit(0)).alias("braking"),
        F.col("Distance").alias("metres"),
    )


def shown(laps: DataFrame) -> DataFrame:
    """The lap's figures from its sums."""
    return laps.withColumns(
        {
            "seconds": (F.col("last_us") - F.col("first_us")) / F.lit(1_000_000.0),
            "mean_speed": F.col("speed_tenths") / F.col("samples") / F.lit(10.0),
            "throttle_share": F.col("full_throttle") / F.col("samples"),
            "braking_share": F.col("braking") / F.col("samples"),
        }
    )


def lap_summary(samples: DataFrame) -> DataFrame:
    """The sums of all laps of a table of samples, at once."""
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return measured(samples).groupBy(*K.LAP).agg(
        *[merge[how](name).alias(name) for name, how in SUMS.items()]
    )


def _partial(batches):
    """Sums of each batch's samples by lap."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sums = table.group_by(K.LAP, use_threads=False).aggregate(list(SUMS.items()))
        named = sums.select([*K.LAP, *[f"{name}_{how}" for name, how in SUMS.items()]])
        yield from named.rename_columns([*K.LAP, *SUMS]).combine_chunks().to_batches()


def _so_far(state: GroupState) -> pa.Table:
    """The laps that a share of the cars has so far."""
    if not state.exists:
        return KEPT.empty_table()
    batch = pa.ipc.read_record_batch(pa.py_buffer(state.get[0]), KEPT)
    return pa.Table.from_batches([batch])


def _follow(grace_us: int, horizon_ms: int):
    """The step of a share of the cars: partial laps that arrived, and these cars' laps so far. A
    car whose `until` the watermark has passed has been silent for the horizon."""
    merge = [*SUMS.items(), ("status", "max"), ("version", "max"), ("until", "max"), ("arrived", "max")]

    def fresh(frame: pd.DataFrame) -> pa.Table:
        laps = frame[[*K.LAP, *SUMS]].assign(status=OPEN, version=0, until=0, arrived=1)
        return pa.Table.from_pandas(laps, KEPT, preserve_index=False)

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(K.LAP, use_threads=False).aggregate(merge)
        names = [*K.LAP, *[f"{name}_{how}" for name, how in merge]]
        return sums.select(names).rename_columns(KEPT.names).cast(KEPT)

    def step(key, frames, state: GroupState):
        kept, more = _so_far(state), []
        if not state.hasTimedOut:
            for frame in frames:
                more.append(fresh(frame))
                # Laps are merged with at least as many rows, so the work stays in proportion.
                if sum(map(len, more)) > len(kept):
                    kept, more = merged([kept, *more]), []
        if more:
            kept = merged([kept, *more])
        laps = kept.sort_by([(name, "ascending") for name in K.LAP]).to_pandas()
        now = state.getCurrentWatermarkMs()
        car = (laps[K.SESSION_DRIVER] != laps[K.SESSION_DRIVER].shift()).any(axis=1).cumsum()
        cars = laps.groupby(car)
        arrived = laps["arrived"] == 1
        heard = cars["arrived"].transform("max") == 1
        last_ms = cars["last_us"].transform("max") // 1000
        laps["until"] = laps["until"].mask(heard, last_ms.clip(lower=now) + horizon_ms)
        silent = laps["until"] < now

        # An open lap is closed when its car is silent, or has driven on in its newest lap.
        newest = cars["LapNumber"].transform("max") == laps["LapNumber"]
        driven = laps["last_us"] + grace_us < cars["last_us"].transform("last")
        laps["status"] = laps["status"].mask(arrived & (laps["status"] == CLOSED), CORRECTED)
        ended = (laps["status"] == OPEN) & (silent | (driven & ~newest))
        laps["status"] = laps["status"].mask(ended, CLOSED)
        changed = arrived | ended
        laps["version"] += changed.astype("int32")
        laps["arrived"] = 0

        if changed.any():
            rows = laps.loc[changed, [*K.LAP, *SUMS, "status", "version"]]
            yield rows.assign(status=rows["status"].map(dict(enumerate(STATUS))))
        left = laps[~silent]
        if left.empty:
            state.remove()
        else:
            batch = pa.RecordBatch.from_pandas(left, KEPT, preserve_index=False)
            state.update((batch.serialize().to_pybytes(),))
            state.setTimeoutTimestamp(int(left["until"].min()))

    return step


def live_laps(
    samples: DataFrame, grace_s: float = 5.0, horizon_s: int = 6 * 3600, shares: int = SHARES
) -> DataFrame:
    """The rows of laps as samples of the stream arrive: sums, status and version. `shares` stays
    the same for as long as a checkpoint is used."""
    partial = measured(samples).mapInArrow(_partial, f"{LAP_KINDS}, {SUM_KINDS}")
    timed = partial.withColumn("_at", F.timestamp_micros("last_us")).withWatermark(
        "_at", f"{horizon_s} seconds"
    )
    share = F.pmod(F.hash(*K.SESSION_DRIVER), F.lit(shares))
    return timed.withColumn("_share", share).groupBy("_share").applyInPandasWithState(
        _follow(int(grace_s * 1_000_000), horizon_s * 1000),
        ROWS, "laps binary", "append", GroupStateTimeout.EventTimeTimeout,
    )


def follow(
    spark: SparkSession, samples: str, laps: str, checkpoint: str, grace_s: float = 5.0,
    horizon_s: int = 6 * 3600, files_at_once: int = 1000, shares: int = SHARES,
) -> StreamingQuery:
    """Takes in all sample files that arrived since the last run and adds rows to the folder `laps`,
    a folder per batch. A batch that is run again after a failure replaces its folder."""
    arrived = (
        spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_at_once).parquet(samples)
    )

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{laps}/batch={number}")

    return (
        live_laps(arrived, grace_s, horizon_s, shares).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_history(spark: SparkSession, laps: str) -> DataFrame:
    return spark.read.schema(f"{ROWS}, batch int").parquet(laps)


def read_laps(spark: SparkSession, laps: str) -> DataFrame:
    """Each lap as it is known last."""
    newest = Window.partitionBy(*K.LAP).orderBy(F.col("version").desc(), F.col("batch").desc())
    ranked = read_history(spark, laps).withColumn("_rank", F.row_number().over(newest))
    return ranked.where("_rank = 1").drop("_rank", "batch")

"""Ordered steps inside groups - previous row, running sum, group values - for groups of any size.

`cut` gives every row a `_piece`, a bucket of a fixed width that rises with the order wanted
later. Windows are keyed by (group, piece); what a piece needs from outside comes from a summary
with one row per piece, and aggregates of whole groups are joined back. The plan is the same
for every input, and building it starts no job.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Rows between the cuts of `around`.
STRETCH = 10_000


def bucket(column, width: float):
    """Number of the stretch of `width` that holds the value. It rises as rows are sorted: nulls
    come first, then negative values, NaN comes last."""
    value = F.col(column) if isinstance(column, str) else column
    number = F.floor(value / F.lit(float(width)))
    return (
        F.when(value.isNull(), F.lit(LOWEST))
        .when(F.isnan(value.cast("double")), F.lit(HIGHEST))
        .otherwise(number)
    )


def cut(df: DataFrame, piece) -> DataFrame:
    """Adds `_piece`, which must rise with the order wanted later and never be null."""
    return df.withColumn("_piece", piece)


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys match each other, as they do in windows."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])


def pieces(keys: list[str]):
    """Window over the pieces of a group, in order."""
    return Window.partitionBy(*keys).orderBy("_piece")


def inside(keys: list[str]):
    """Window over the rows of a piece."""
    return Window.partitionBy(*keys, "_piece")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str):
    """Adds the struct `name` of `columns` of the row before, in the order of `order`."""
    row = F.struct(*columns)
    within = df.withColumn(name, F.lag(row).over(inside(keys).orderBy(*order)))
    last = F.max(F.struct(*order, row.alias("_row"))).alias("_last")
    carried = (
        df.groupBy(*keys, "_piece")
        .agg(last)
        .select(*keys, "_piece", F.lag("_last._row").over(pieces(keys)).alias("_carried"))
    )
    return (
        joined(within, carried, [*keys, "_piece"])
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_carried")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], **values) -> DataFrame:
    """Adds running sums, one column per `name=value`, the current row included."""
    upto = inside(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = df.withColumns({f"_v_{name}": value for name, value in values.items()})
    earlier = pieces(keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        named.groupBy(*keys, "_piece")
        .agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
        .select(
            *keys, "_piece",
            *[F.sum(f"_s_{name}").over(earlier).alias(f"_from_{name}") for name in values],
        )
    )
    summed = named.withColumns({name: F.sum(f"_v_{name}").over(upto) for name in values})
    return (
        joined(summed, starts, [*keys, "_piece"])
        .withColumns(
            {name: F.col(name) + F.coalesce(f"_from_{name}", F.lit(0)) for name in values}
        )
        .drop(*[f"_v_{name}" for name in values], *[f"_from_{name}" for name in values])
    )


def group_values(df: DataFrame, keys: list[str], **values) -> DataFrame:
    """Adds aggregates of the whole group to its rows: partial aggregates, joined back."""
    totals = df.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()])
    return joined(df, totals, keys)


def around(df: DataFrame, keys: list[str], place: str, half: int, **values) -> DataFrame:
    """Adds window aggregates over the rows at most `half` places away in the group. `place`
    numbers the rows of a group from 1. A group is cut by place, and each stretch also gets the
    `half` rows on either side, which are dropped again afterwards."""

    def stretch(position):
        return F.floor(position / F.lit(STRETCH))

    at = F.col(place)
    copies = F.array_distinct(F.array(stretch(at), stretch(at - half), stretch(at + half)))
    frame = Window.partitionBy(*keys, "_stretch").orderBy(place).rowsBetween(-half, half)
    return (
        df.withColumn("_stretch", F.explode(copies))
        .withColumns({name: value.over(frame) for name, value in values.items()})
        .where(F.col("_stretch") == stretch(at))
        .drop("_stretch")
    )

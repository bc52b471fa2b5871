"""Group-wise steps that stay spread out when one group holds a large share of all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, keys: list[str], piece: str, order: list, name: str, known: DataFrame | None = None
) -> DataFrame:
    """1-based position of each row in its group, ordered by `piece` and then `order`.

    A group is numbered piece by piece, in as many tasks; the start of each piece comes from the
    row counts of the earlier ones. `piece` must rise with the wanted order. The starts are dealt
    and sorted with the rows, so these move once and are joined with nothing.

    `known` has one row for some of the values of key columns that it shares: its other columns are
    added, and rows without a match are left out. It meets the starts, not the rows."""
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, piece)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    added = []
    if known is not None:
        shared = [key for key in keys if key in known.columns]
        added = [column for column in known.columns if column not in shared]
        starts = starts.join(known, shared)
    begins = F.struct("_start", *added)
    rows = df.withColumn("_begins", F.lit(None).cast(starts.select(begins).schema[0].dataType))
    firsts = starts.select(*keys, piece, begins.alias("_begins"))
    within = Window.partitionBy(*keys, piece).orderBy(F.col("_begins").isNull(), *order)
    sofar = within.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(firsts, allowMissingColumns=True)
        .withColumn("_place", F.row_number().over(within))
        .withColumn("_known", F.first("_begins").over(sofar))
        .where(F.col("_begins").isNull() & F.col("_known").isNotNull())
        .withColumn(name, (F.col("_known._start") + F.col("_place") - 1).cast("int"))
        .select(*df.columns, name, *[F.col(f"_known.{column}").alias(column) for column in added])
    )


def exact_ranks(
    df: DataFrame, keys: list[str], value: str, indexes: dict, width: float
) -> DataFrame:
    """The values that stand at given places when each group is sorted by `value`.

    `indexes` maps a result column to a function from the group's row count (a column) to a
    0-based place. Equal values are first merged to (value, count), then counted in bins of
    `width`; only bins that hold a wanted place are sorted. No task sees a whole group, so a
    group may hold any share of the rows. `_total` is the row count of the group.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col("_value") / F.lit(width)))
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_below", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_in_bin").over(group))
    )
    places = {name: index(F.col("_total")) for name, index in indexes.items()}
    wanted = F.lit(False)
    for place in places.values():
        inside = (F.col("_below") <= place) & (place < F.col("_below") + F.col("_in_bin"))
        wanted = wanted | inside
    upto = Window.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        counted.join(bins.where(wanted).drop("_in_bin"), [*keys, "_bin"])
        .withColumn("_after", F.col("_below") + F.sum("_n").over(upto))
        .withColumn("_before", F.col("_after") - F.col("_n"))
    )
    picks = [
        F.max(
            F.when((F.col("_before") <= place) & (place < F.col("_after")), F.col("_value"))
        ).alias(name)
        for name, place in places.items()
    ]
    return ranked.groupBy(*keys).agg(*picks, F.max("_total").alias("_total"))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], width: float
) -> DataFrame:
    """Exact, linearly interpolated quantiles of `value` per group, one column per fraction."""

    def rank(fraction, total):
        return F.lit(float(fraction)) * (total - 1)

    indexes = {}
    for name, fraction in fractions.items():
        indexes[f"_{name}_lo"] = lambda total, f=fraction: F.floor(rank(f, total))
        indexes[f"_{name}_hi"] = lambda total, f=fraction: F.ceil(rank(f, total))
    found = exact_ranks(df, keys, value, indexes, width)

    def between(name, fraction):
        part = rank(fraction, F.col("_total"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (part - F.floor(part))).alias(name)

    return found.select(*keys, *[between(n, f) for n, f in fractions.items()])

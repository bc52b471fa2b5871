"""As-of joins for groups of any size: the last row of another table at or before an instant."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import ordered


def last_before(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], width: float
) -> DataFrame:
    """Adds to every left row the `columns` and `_since` (its `at`) of the group's last right row
    whose `at` is not later; nulls where there is none, or where the left `at` is null.

    Of right rows at the same instant the greatest by `columns` counts; those without an instant
    never do. Null keys match each other. Both tables are united and cut into stretches of `width`;
    within a stretch the last right row is carried along, and between stretches it comes from a
    summary with a row per stretch. So no task holds a whole group, and nothing is compared pairwise.
    """
    own = [name for name in left.columns if name not in keys]
    found = F.struct(F.col(at).alias("_since"), *columns)
    asked = left.select(
        *keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(found).schema[0].dataType).alias("_found"),
        F.struct(*own).alias("_row"),
    )
    known = right.where(F.col(at).isNotNull()).select(
        *keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_side"), found.alias("_found"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"),
    )
    both = ordered.cut(known.unionByName(asked), ordered.bucket("_at", width))
    upto = ordered.inside(keys).orderBy("_at", "_side", "_found").rowsBetween(
        Window.unboundedPreceding, 0
    )
    carried = F.last("_in_piece", ignorenulls=True).over(
        ordered.pieces(keys).rowsBetween(Window.unboundedPreceding, -1)
    )
    newest = F.max(F.when(F.col("_side") == 0, F.struct("_at", "_found"))).alias("_top")
    earlier = (
        both.groupBy(*keys, "_piece").agg(newest)
        .select(*keys, "_piece", F.col("_top._found").alias("_in_piece"))
        .withColumn("_carried", carried)
        .drop("_in_piece")
    )
    within = both.withColumn("_found", F.last("_found", ignorenulls=True).over(upto)).where("_side = 1")
    return ordered.joined(within, earlier, [*keys, "_piece"]).withColumn(
        "_found", F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    ).select(*keys, "_row.*", "_found.*")

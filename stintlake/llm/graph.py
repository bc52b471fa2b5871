"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.llm.common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Large-star and small-star rounds: every node's larger neighbours, then every node and its
    smaller neighbours, are linked to the smallest node among them. Minima are partial aggregates,
    so a hub with any number of links never meets in one task as a list, and as they are stored
    before they are joined back, the join may split a hub's links. They grow with the input, so the
    joins are named and broadcast nothing. Each round is written to the
    shared folder; the rounds end when a round changes nothing, about the logarithm of the
    longest path. Links to itself and repeated links may occur. No links: no rows."""
    now = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(
            both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least"
        )
        large = (
            both.where("b > a").join(near.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        down = stored(large.where("a <> b").distinct(), "links")
        # Every link now goes from the larger node to the smaller.
        lowest = stored(down.groupBy("a").agg(F.min("b").alias("least")), "lowest")
        small = (
            down.join(lowest.hint("merge"), "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = stored(small, "links")
        sums = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

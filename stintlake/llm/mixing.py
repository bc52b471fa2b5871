"""Mixing sources to target weights.

Every document gets a random key from a hash of its id. Within a source the keys are cut into
ranges; the words of each range are summed, running sums over the ranges say where each begins,
and a window inside one range finishes the prefix sum. A source larger than a task is thus
handled in up to 4,096 pieces, and no step holds a source.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlake.llm.common import WORD, let, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this multiple of its words.
MOST_EPOCHS = 3
#: Hex digits of the random key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_EPOCHS) -> DataFrame:
    """Adds to (source, source_size) the `target`: the total is shared by weight, no source above
    `most` times its size, the excess shared again by weight until none is above.

    Sources fill up in the order of their limit over weight, so the fixed point follows from
    running sums in that order. The frame has a row per source: a small table, one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1)
    named = sizes.select(
        "source",
        "source_size",
        weight.cast("long").alias("weight"),
        (F.col("source_size") * most).alias("limit"),
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = named.select(
        "*",
        (
            F.sum("source_size").over(everything) - F.sum("limit").over(upto) + F.col("limit")
        ).alias("rest"),
        (
            F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
        ).alias("rest_weight"),
    ).withColumn(
        # Products as doubles: they may pass the range of long.
        "full",
        F.col("rest").cast("double") * F.col("weight")
        > F.col("limit").cast("double") * F.col("rest_weight"),
    )
    # The sources that fill up come first in this order; what they leave goes to the others.
    left = F.first(F.when(~F.col("full"), F.col("rest")), True).over(everything)
    left_weight = F.first(F.when(~F.col("full"), F.col("rest_weight")), True).over(everything)
    shared = F.col("weight") * left.cast("double") / left_weight
    return ahead.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"),
    )


def mix(docs: DataFrame, payload: list[str] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, `payload` columns, size, source_size, target, taken. Whole epochs of a
    source come first; the last, partial one takes documents in the order of their random key and
    cuts at the budget, so that at most one document per source is taken in part and the words
    taken are the target rounded down.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Repeated
    rows: each counts. Equal keys: ordered by size, so results agree between runs. No rows: none.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        "doc_id", "source", *payload, n_words(F.col("text")).alias("size"), key.alias("_key")
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    words = docs.select("source", n_words(F.col("text")).alias("size"), key.alias("_key"))
    ranges = words.groupBy("source", F.substring("_key", 1, RANGE_DIGITS).alias("_range")).agg(
        F.sum("size").alias("_words")
    )
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    begun = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    starts = begun.alias("r").join(
        targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))
    ).select("r.source", "_range", "_before", "source_size", "target")
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_key", "size", *payload)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), last - F.col("_before") - F.col("_inside"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), part)
    return (
        placed.alias("p")
        .join(
            starts.alias("s"),
            F.col("p.source").eqNullSafe(F.col("s.source"))
            & (F.col("p._range") == F.col("s._range")),
        )
        .select(
            "doc_id", "p.source", *payload, "size", "source_size", "target",
            taken.cast("long").alias("taken"),
        )
    )


def first_words(text, n):
    """The text up to the end of its n-th word."""
    found = let(
        F.regexp_extract_all(text, F.lit(r"(?s)[\x20\x09-\x0D]*" + WORD), F.lit(0)),
        lambda words: F.array_join(F.slice(words, 1, n.cast("int")), ""),
    )
    return found


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of `docs` (doc_id, text, lang, source, n_chars): a row for
    every epoch of a document, and the first words of the one that the budget cuts."""
    chosen = mix(docs, ["text", "lang", "n_chars"]).where(F.col("taken") > 0)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(
            F.array().cast("array<bigint>")
        )
    )
    each = chosen.withColumn("_words", F.explode(copies))
    cut = F.col("_words") >= 0
    text = F.when(cut, first_words(F.col("text"), F.col("_words"))).otherwise(F.col("text"))
    return each.withColumn("text", text).select(
        "doc_id", "text", "lang", "source",
        F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"),
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), named AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         3 * source_size AS lim
  FROM sizes
), ahead AS (
  SELECT *, (sum(source_size) OVER () - sum(lim) OVER w + lim)::BIGINT AS rest,
         (sum(weight) OVER () - sum(weight) OVER w + weight)::BIGINT AS rest_weight
  FROM named
  WINDOW w AS (ORDER BY lim / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), marked AS (
  SELECT *, rest::DOUBLE * weight > lim::DOUBLE * rest_weight AS filled FROM ahead
), free AS (
  SELECT max(rest) AS rest, max(rest_weight) AS rest_weight
  FROM (SELECT rest, rest_weight FROM marked WHERE NOT filled ORDER BY rest_weight DESC LIMIT 1)
), targets AS (
  SELECT m.source, m.source_size,
         CASE WHEN filled THEN lim::DOUBLE ELSE weight * f.rest::DOUBLE / f.rest_weight END AS target
  FROM marked m CROSS JOIN free f
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (n * size + greatest(0, least(size, budget - n * source_size - before)))::BIGINT AS taken
FROM epochs
"""

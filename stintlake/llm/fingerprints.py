"""Document fingerprints by winnowing, in DataFrame functions only.

Text is read as words, words of over 12 characters as parts of 12. Every run of K words has a
rolling hash, the polynomial of its words' hashes modulo 2^31 - 1; of every WINDOW successive hashes
the smallest is kept, the rightmost of equal ones, with its place. Two texts that share
K + WINDOW - 1 successive words therefore share a kept hash.
"""

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.llm.common import let, table

WORD_PART = r"[^\x20\x09-\x0D]{1,12}"
#: A power of two: hashes of 1, 2 and then 4 words.
K = 4
#: A power of two: minima over 1, 2, 4 and then 8 hashes.
WINDOW = 8
#: Ranges of ids for each shuffle partition.
RANGES = 4

HASH_BITS = 31
PLACE_MASK = (1 << 31) - 1
#: The prime of the rolling hash; products of two remainders stay under 2^62.
PRIME = (1 << 31) - 1
BASE = 1_000_003


def _longs(values) -> Column:
    return F.array().cast("array<bigint>") if values is None else values


def _gram_hashes(hashes: Column) -> Column:
    """The rolling hash of every run of K words, h[0] B^(K-1) + ... + h[K-1] modulo PRIME, and of
    all words where there are fewer. Neighbouring runs share their parts: the hash of 2n words is
    that of the first n, shifted by B^n, plus that of the next n, so each doubling is one pass."""

    def doubled(found: Column, n: int) -> Column:
        if n == K:
            return found
        shift, left = pow(BASE, n, PRIME), F.size(found) - n
        joined = F.zip_with(
            F.slice(found, F.lit(1), left),
            F.slice(found, F.lit(1 + n), left),
            lambda x, y: (x * F.lit(shift).cast("long") + y) % F.lit(PRIME).cast("long"),
        )
        return let(joined, lambda x: doubled(x, 2 * n))

    words = F.transform(hashes, lambda h: F.pmod(h, F.lit(PRIME).cast("long")))
    n = F.size(hashes)
    few = F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda done, h: (done * F.lit(BASE).cast("long") + h) % F.lit(PRIME).cast("long"),
    )
    return (
        F.when(n >= K, let(words, lambda x: doubled(x, 1)))
        .when(n > 0, F.array(few))
        .otherwise(_longs(None))
    )


def _with_place(grams: Column) -> Column:
    """Hash and place in one long that is smaller for a smaller hash and, of equal ones, for the
    place further right."""
    return F.transform(
        grams,
        lambda g, i: F.shiftleft(g.bitwiseAND(F.lit(PLACE_MASK).cast("long")), HASH_BITS).bitwiseOR(
            (F.lit(PLACE_MASK).cast("long") - i)
        ),
    )


def _window_minima(values: Column) -> Column:
    """The smallest of every WINDOW successive values; of all where there are fewer."""

    def paired(found: Column, step: int) -> Column:
        left = F.size(found) - step
        return F.zip_with(
            F.slice(found, F.lit(1), left), F.slice(found, F.lit(1 + step), left), lambda x, y: F.least(x, y)
        )

    def from_step(found: Column, step: int) -> Column:
        if step == WINDOW:
            return found
        return let(paired(found, step), lambda x: from_step(x, 2 * step))

    return (
        F.when(F.size(values) >= WINDOW, from_step(values, 1))
        .when(F.size(values) > 0, F.array(F.array_min(values)))
        .otherwise(_longs(None))
    )


def winnow(text: Column) -> Column:
    """The kept (hash, place) pairs of a text, packed into longs, in the order of their places."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PART), F.lit(0))
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: let(
            _gram_hashes(hashes),
            lambda grams: let(
                _with_place(grams), lambda placed: F.array_distinct(_window_minima(placed))
            ),
        ),
    )


def hash_of(kept: Column) -> Column:
    return F.shiftright(kept, HASH_BITS)


def place_of(kept: Column) -> Column:
    return F.lit(PLACE_MASK).cast("long") - kept.bitwiseAND(F.lit(PLACE_MASK).cast("long"))


def as_text(kept: Column) -> Column:
    """hash:place of every kept hash, comma-joined; the hash in hex."""
    return F.array_join(
        F.transform(kept, lambda v: F.concat(F.hex(hash_of(v)), F.lit(":"), place_of(v))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Distinct hashes in both over those in either; 1 for two texts without words."""

    def shares(x, y):
        both = F.size(F.array_intersect(x, y))
        every = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both
        return F.when(every > 0, both / every).otherwise(F.lit(1.0))

    return let(F.transform(a, hash_of), lambda x: let(F.transform(b, hash_of), lambda y: shares(x, y)))


def successors(docs: DataFrame) -> tuple[DataFrame, "Window"]:
    """The documents (doc_id, text) and copies of some, with a window in which each document comes
    right before its successor: falling doc_id, nulls last (as the least id there can be), equal
    ids by a hash of the text, and after the last the first. Copies have `_copy` 1 and are to be
    dropped after use.

    The ids are cut into ranges at approximate quantiles; an id (or null) that stands at several
    of them holds many rows, and its rows are cut into as many ranges by the hash of the text. The
    first document of each range is copied to the end of the range before it, so windows inside
    ranges are enough and whole texts are shuffled once. There are RANGES times the shuffle
    partitions of ranges at most, so their firsts may go through the driver and be broadcast."""
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rises as the id falls.
    down = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(down, shares, 20 * ranges).alias("cuts")).first()["cuts"]
    cuts = []
    for value, times in sorted(Counter(found or []).items()):
        cuts.append((value, -(1 << 63)))
        cuts += [(value, (k << 64) // times - (1 << 63)) for k in range(1, times)]
    kind = "array<struct<down:bigint,tie:bigint>>"
    below = F.array(
        *[F.struct(F.lit(d).alias("down"), F.lit(t).alias("tie")) for d, t in cuts]
    ).cast(kind)
    tie = F.xxhash64("text")
    here = F.struct(down.alias("down"), tie.alias("tie"))
    place = F.size(F.filter(below, lambda c: c <= here))
    rows = docs.select(
        "doc_id", "text", place.alias("_range"), down.alias("_down"), tie.alias("_tie")
    )
    heads = (
        rows.groupBy("_range").agg(F.min(F.struct("_down", "_tie")).alias("h")).orderBy("_range")
    ).collect()
    before = [(h["_range"], *h["h"], heads[i - 1]["_range"]) for i, h in enumerate(heads)]
    kinds = "_range int, _down long, _tie long, _before int"
    marked = rows.join(
        F.broadcast(spark.createDataFrame(before, kinds)), ["_range", "_down", "_tie"], "left"
    )
    places = F.array_compact(
        F.array(
            F.struct(F.col("_range").alias("at"), F.lit(0).alias("copy")),
            F.when(
                F.col("_before").isNotNull(),
                F.struct(F.col("_before").alias("at"), F.lit(1).alias("copy")),
            ),
        )
    )
    placed = marked.withColumn("_place", F.explode(places)).select(
        "doc_id", "text", "_down", "_tie",
        F.col("_place.at").alias("_at"), F.col("_place.copy").alias("_copy"),
    )
    return placed, Window.partitionBy("_at").orderBy("_copy", "_down", "_tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, the edited text's SHA-256, the fingerprints of the text
    and of the edited text, and the likeness of the text's to the edited text's and to the next
    document's.

    Null or empty text: n_chars 0, an empty fingerprint, like only to other empty ones. Fewer than
    K words: one hash of them all. A single document is its own successor. Repeated rows: each
    comes back. No rows: none."""
    placed, order = successors(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    chained = (
        placed.withColumn("_next_text", F.lead("text").over(order))
        .withColumn("_kept", winnow(F.col("text")))
        .withColumn("_next_kept", F.lead("_kept").over(order))
        .where("_copy = 0")
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next_text", F.lit(1), half))
    found = let(
        edited,
        lambda e: let(
            winnow(e),
            lambda kept: F.struct(
                F.sha2(e, 256).alias("sha"),
                as_text(kept).alias("fingerprint"),
                likeness(F.col("_kept"), kept).alias("near"),
            ),
        ),
    )
    return chained.withColumn("_edited", found).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.col("_edited.sha").alias("edited_sha256"),
        as_text(F.col("_kept")).alias("fingerprint"),
        F.col("_edited.fingerprint").alias("edited_fingerprint"),
        F.col("_edited.near").alias("near_edited"),
        likeness(F.col("_kept"), F.col("_next_kept")).alias("near_next"),
    )


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

"""Column expressions shared by the operators."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintlake import constants as K


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value, digits: int = 0) -> Column:
    """Rounds the binary value, halves upwards: the result of a decimal edge format."""
    factor = float(10 ** digits)
    return F.floor(as_column(value) * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def whole(value) -> Column:
    """Nearest integer, halves upwards, also below zero (-2.5 gives -2)."""
    return F.floor(as_column(value) + F.lit(0.5)).cast("int")


def finite_or_zero(value) -> Column:
    value = as_column(value)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(math.inf))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(as_column(value), F.lit(low)), F.lit(high))


def slug(name) -> Column:
    """Race name to folder name: spaces to underscores, lower case, accents kept."""
    return F.lower(F.replace(as_column(name), F.lit(" "), F.lit("_")))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def display_name(race_slug) -> Column:
    """Readable race name: the fixed exceptions, else the slug without suffix in title case."""
    race_slug = as_column(race_slug)
    plain = F.initcap(
        F.replace(F.replace(race_slug, F.lit("_grand_prix"), F.lit("")), F.lit("_"), F.lit(" "))
    )
    return F.coalesce(F.element_at(literal_map(K.CIRCUIT_NAMES), race_slug), plain)


def surname(name) -> Column:
    """Full name without its first word; a one-word name stays as it is."""
    name = as_column(name)
    words = F.split(F.trim(name), r"\s+")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(F.size(words) > 1, rest).otherwise(name)


def short_date(day) -> Column:
    return F.date_format(as_column(day), "dd/MM/yy")


def is_dry(compound="Compound") -> Column:
    return as_column(compound).isin(K.DRY_COMPOUNDS)


def pit_loss(race_slug) -> Column:
    """Seconds lost in the pits at a circuit."""
    known = F.element_at(literal_map(K.PIT_LOSS), as_column(race_slug))
    return F.coalesce(known, F.lit(K.PIT_LOSS_DEFAULT))


def angle_difference(a, b) -> Column:
    """a - b wrapped to [-pi, pi]; both angles come from atan2, so one turn is enough."""
    d = as_column(a) - as_column(b)
    turn = F.lit(2 * math.pi)
    return (
        F.when(d > F.lit(math.pi), d - turn)
        .when(d < F.lit(-math.pi), d + turn)
        .otherwise(d)
    )


def interval_seconds(value) -> Column:
    """Day-time interval to seconds."""
    return as_column(value).cast("interval second").cast("decimal(18,6)").cast("double")


def clock_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone is."""
    ts = as_column(ts)
    days = F.unix_date(ts.cast("date")).cast("long")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def hour_bucket(ts) -> Column:
    ts = as_column(ts)
    return F.unix_date(ts.cast("date")) * 24 + F.hour(ts)

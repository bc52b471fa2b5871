"""The race and driver catalogue: calendar, lake contents, teams and names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake import constants as K
from stintlake.functions import columns as C
from stintlake.operators import quality as Q


def team_by_race(laps: DataFrame) -> DataFrame:
    """The team each driver did most laps for in a race; ties: the first name."""
    counts = laps.groupBy(*K.SESSION_DRIVER, "Team").agg(F.count(F.lit(1)).alias("_laps"))
    first = F.min(F.struct(-F.col("_laps"), F.col("Team").alias("Team")))
    return counts.groupBy(*K.SESSION_DRIVER).agg(first.alias("_first")).select(
        *K.SESSION_DRIVER, "_first.Team"
    )


def team_by_season(teams: DataFrame) -> DataFrame:
    """The team of a driver in the season's first race by name (input: `team_by_race`)."""
    return teams.groupBy("Year", "Driver").agg(F.min_by("Team", "GrandPrix").alias("Team"))


def race_laps(laps: DataFrame) -> DataFrame:
    return laps.groupBy(*K.RACE).agg(F.max("LapNumber").alias("vueltas"))


def driver_names(results: DataFrame, calendar: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Full name of each driver code in a season, from the first race in the lake that lists it."""
    rounds = calendar.select("Year", C.slug("EventName").alias("GrandPrix"), "RoundNumber")
    usable = (F.col("Abbreviation") != "") & (F.col("FullName") != "")
    return (
        results.where(usable)
        .join(telemetry.select(*K.RACE).distinct(), K.RACE, "left_semi")
        .join(rounds, K.RACE)
        .groupBy("Year", F.col("Abbreviation").alias("Driver"))
        .agg(F.min(F.struct("RoundNumber", "FullName")).alias("_first"))
        .select("Year", "Driver", F.col("_first.FullName").alias("name"))
    )


def catalogue_races(
    calendar: DataFrame, telemetry: DataFrame, laps: DataFrame, as_of
) -> DataFrame:
    """One row per calendar race: whether it was held, is in the lake and can be drawn."""
    quality = Q.race_position_quality(telemetry).select(*K.RACE, "quality")
    stored = telemetry.select(*K.RACE).distinct().withColumn("_stored", F.lit(True))
    quality_or_zero = F.coalesce("quality", F.lit(0.0))
    return (
        calendar.withColumn("GrandPrix", C.slug("EventName"))
        .join(stored, K.RACE, "left")
        .join(quality, K.RACE, "left")
        .join(race_laps(laps), K.RACE, "left")
        .select(
            F.col("Year").alias("year"),
            F.col("GrandPrix").alias("slug"),
            C.display_name("GrandPrix").alias("nombre"),
            F.col("RoundNumber").cast("int").alias("ronda"),
            F.date_format("EventDate", "yyyy-MM-dd").alias("fecha"),
            (F.col("EventDate") < F.lit(as_of)).alias("corrida"),
            F.coalesce("_stored", F.lit(False)).alias("tiene_datos"),
            quality_or_zero.alias("posicion_calidad"),
            (quality_or_zero >= K.POSITION_OK).alias("posicion_ok"),
            "vueltas",
        )
    )


def catalogue_drivers(
    calendar: DataFrame, telemetry: DataFrame, laps: DataFrame, names: DataFrame
) -> DataFrame:
    """The drivers with telemetry in each calendar race, with team and name."""
    races = calendar.select("Year", C.slug("EventName").alias("GrandPrix")).distinct()
    teams = team_by_race(laps)
    season = team_by_season(teams).withColumnRenamed("Team", "_season_team")
    return (
        Q.telemetry_drivers(telemetry)
        .join(races, K.RACE, "left_semi")
        .join(teams, K.SESSION_DRIVER, "left")
        .join(season, ["Year", "Driver"], "left")
        .join(names, ["Year", "Driver"], "left")
        .select(
            F.col("Year").alias("year"),
            F.col("GrandPrix").alias("slug"),
            F.col("Driver").alias("code"),
            F.coalesce(
                F.when(F.col("Team") != "", F.col("Team")), "_season_team", F.lit(K.NO_TEAM)
            ).alias("team"),
            F.coalesce("name", "Driver").alias("name"),
        )
    )


def teams(drivers: DataFrame) -> DataFrame:
    return drivers.select("team").distinct()


def catalogue(races: DataFrame, drivers: DataFrame) -> DataFrame:
    """The nested catalogue: each race with its drivers, ordered by code."""
    grids = drivers.groupBy("year", "slug").agg(
        F.array_sort(F.collect_list(F.struct("code", "team", "name"))).alias("pilotos")
    )
    empty = F.array().cast("array<struct<code:string,team:string,name:string>>")
    return (
        races.join(grids, ["year", "slug"], "left")
        .withColumn("pilotos", F.coalesce("pilotos", empty))
    )


def catalogue_summary(races: DataFrame) -> DataFrame:
    """Per season: calendar races, races with data, and the last of these by round."""
    last = F.max(F.when(F.col("tiene_datos"), F.struct("ronda", "slug")))
    return (
        races.groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("races"),
            F.count_if("tiene_datos").alias("with_data"),
            last.alias("_last"),
        )
        .select("year", "races", "with_data", F.col("_last.slug").alias("last_slug"))
    )


def default_race(races: DataFrame) -> DataFrame:
    """The race to open first: the latest one with data."""
    stored = races.where(F.col("tiene_datos"))
    return stored.agg(F.max(F.struct("year", "ronda", "slug")).alias("_last")).select(
        "_last.year", "_last.slug"
    )


def drivers_by_team(calendar: DataFrame, drivers: DataFrame) -> DataFrame:
    """Drivers of each race for a menu grouped by team, with surname and short date."""
    dates = calendar.select(
        F.col("Year").alias("year"),
        C.slug("EventName").alias("slug"),
        C.short_date("EventDate").alias("short_date"),
    )
    return drivers.join(dates, ["year", "slug"]).select(
        "year", "slug", "short_date", "team", "code", C.surname("name").alias("surname")
    )

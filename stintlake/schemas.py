"""Schemas of the bronze and silver tables."""

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "smallint": T.ShortType(), "tinyint": T.ByteType(), "float": T.FloatType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """A schema from "name type, name type"; `nested` appends the columns that are not flat. Spark's
    own DDL parser needs a session, and modules must import without one."""
    fields = [field.split() for field in text.split(",")]
    schema = T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])
    for name, kind in nested.items():
        schema = schema.add(name, kind)
    return schema


BRONZE_LAPS = _struct(
    "Driver string, Team string, LapNumber double, Stint double, Compound string, "
    "TyreLife double, LapTime double, Sector1Time double, Sector2Time double, "
    "Sector3Time double, Year bigint, GrandPrix string"
)
BRONZE_TELEMETRY = _struct(
    "Driver string, Team string, LapNumber smallint, Compound string, SessionTime float, "
    "Distance float, Speed float, RPM smallint, nGear tinyint, Throttle tinyint, "
    "Brake boolean, DRS tinyint, X int, Y int, DriverAhead string, "
    "DistanceToDriverAhead float, Year bigint, GrandPrix string"
)
BRONZE_EVENTS = _struct(
    "Time string, Category string, Message string, Status string, Flag string, Scope string, "
    "Sector string, RacingNumber string, Lap smallint, Year bigint, GrandPrix string"
)
SILVER_LAPS = _struct(
    "Year int, GrandPrix string, Driver string, Team string, LapNumber int, Stint int, "
    "Compound string, TyreLife int, LapTime double, Sector1Time double, Sector2Time double, "
    "Sector3Time double"
)
SILVER_TELEMETRY = _struct(
    "Year int, GrandPrix string, Driver string, Team string, LapNumber int, Compound string, "
    "SessionTime double, Distance double, Speed double, RPM int, nGear int, Throttle double, "
    "Brake int, DRS int, X double, Y double, DriverAhead string, DistanceToDriverAhead double"
)
SILVER_EVENTS = _struct(
    "Time string, Category string, Message string, Status string, Flag string, Scope string, "
    "Sector string, RacingNumber string, Lap smallint, Year int, GrandPrix string"
)
INGEST_REPORT = _struct(
    "gp string, year int, pilotos bigint", faltantes=T.ArrayType(T.StringType())
)
GOLD_RACE = _struct(
    "year int, slug string, nombre string, ronda int, fecha string, corrida boolean, "
    "tiene_datos boolean, posicion_calidad double, posicion_ok boolean, vueltas int",
    pilotos=T.ArrayType(_struct("code string, team string, name string")),
)
GOLD_PREDICTION = _struct(
    "year int, gp string, driver string, compound_inicial string, compound_siguiente string, "
    "total_vueltas int, pit_window int, pit_real int, error_vueltas int, "
    "degradacion_s_vuelta double, costo_estimado_s double, pit_loss_usado double, "
    "vueltas_stint1 bigint"
)
ERA_METRICS = _struct(
    "era string, target string, mae_segundos double, baseline_segundos double, "
    "vueltas_entrenamiento bigint, vueltas_validacion bigint, holdout string",
    years=T.ArrayType(T.IntegerType()),
    circuitos=T.ArrayType(T.StringType()),
    features=T.ArrayType(T.StringType()),
    importancias=T.MapType(T.StringType(), T.DoubleType()),
)

BRONZE = {"laps": BRONZE_LAPS, "telemetry": BRONZE_TELEMETRY, "events": BRONZE_EVENTS}
SILVER = {"laps": SILVER_LAPS, "telemetry": SILVER_TELEMETRY, "events": SILVER_EVENTS}
SILVER_PARTITIONS = {
    "laps": ["Year", "GrandPrix"],
    "telemetry": ["Year", "GrandPrix", "Driver"],
    "events": ["Year", "GrandPrix"],
}

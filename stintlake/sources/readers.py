"""Reading the lake: bronze race files, partitioned silver tables, nested gold documents."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlake import constants as K
from stintlake import schemas
from stintlake.sources import folders, snapshots


def bronze_glob(root: str, year, gps: list[str] | None, kind: str, session: str = "R") -> str:
    races = "*" if not gps else "{" + ",".join(gp.replace(" ", "_").lower() for gp in gps) + "}"
    return f"{root}/{year}/{races}/{session}_{kind}*.parquet"


def read_bronze(
    spark: SparkSession, root: str, year, gps: list[str] | None = None, kind: str = "laps"
) -> DataFrame:
    """The bronze files of a season, as one table: all races found, or those in `gps`."""
    return spark.read.schema(schemas.BRONZE[kind]).parquet(bronze_glob(root, year, gps, kind))


def _unfit(found: T.StructType, wanted: T.StructType) -> str | None:
    """Why a file's columns can't be read as the wanted ones: one is missing, or is text where a
    number is wanted or the other way round. Numbers of any kind may stand for each other."""

    def family(kind):
        return "number" if isinstance(kind, T.NumericType) else kind.simpleString()

    kinds = {field.name: field.dataType for field in found.fields}
    for field in wanted.fields:
        if field.name not in kinds:
            return f"{field.name} is missing"
        kind = kinds[field.name]
        if family(kind) != family(field.dataType) and not isinstance(kind, T.NullType):
            return f"{field.name} is {kind.simpleString()}, not {field.dataType.simpleString()}"
    return None


def read_valid_bronze(
    spark: SparkSession, root: str, year, gps: list[str] | None = None, kind: str = "laps"
) -> tuple[DataFrame | None, set[tuple[int, str]], dict[str, str]]:
    """The bronze files of a season whose columns fit, the (year, race) pairs they belong to, and
    for every other file why it was left out.

    Types are inferred race by race when bronze is written, so a column may be whole numbers in
    one race and fractions in the next. Only footers are read here, one per file of the season."""
    wanted = schemas.BRONZE[kind]
    by_schema: dict[str, list[str]] = {}
    rejected: dict[str, str] = {}
    for file in folders.listed(spark, bronze_glob(root, year, gps, kind)):
        try:
            found = spark.read.parquet(file).schema
        except Exception as error:  # an unreadable file must not stop the other races
            rejected[file] = str(error).splitlines()[0]
            continue
        why = _unfit(found, wanted)
        if why:
            rejected[file] = why
        else:
            by_schema.setdefault(found.json(), []).append(file)
    whole = None
    for files in by_schema.values():
        part = spark.read.parquet(*files).select(
            *[F.col(field.name).cast(field.dataType) for field in wanted.fields]
        )
        whole = part if whole is None else whole.unionByName(part)
    races = {tuple(f.split("/")[-3:-1]) for files in by_schema.values() for f in files}
    spoiled = {tuple(f.split("/")[-3:-1]) for f in rejected}
    return whole, {(int(y), race) for y, race in races - spoiled}, rejected


def read_reports(spark: SparkSession, root: str, year) -> DataFrame:
    path = f"{root}/{year}/*/R_report.json"
    return spark.read.schema(schemas.INGEST_REPORT).json(path, multiLine=True)


def read_silver(
    spark: SparkSession, root: str, kind: str, version: int | None = None
) -> DataFrame:
    """A silver table as last published, or an older state of it; the partition columns come from
    the folder names, typed by schema."""
    return snapshots.read(spark, root, kind, version)


def read_driver(spark: SparkSession, root: str, year: int, gp: str, driver: str) -> DataFrame:
    """One driver's race: only its folder is listed and only the serving columns are read."""
    only = {"Year": year, "GrandPrix": gp, "Driver": driver.upper()}
    wanted = F.lit(True)
    for name, value in only.items():
        wanted = wanted & (F.col(name) == value)
    return (
        snapshots.read(spark, root, "telemetry", only=only)
        .where(wanted)
        .select("Year", "GrandPrix", "Driver", *K.LAP_COLUMNS)
    )


def driver_state(spark: SparkSession, root: str, year: int, gp: str, driver: str) -> str:
    """"missing" without a folder, "empty" with a folder but no rows, else "data"."""
    partition = f"Year={year}/GrandPrix={gp}/Driver={driver.upper()}"
    state = snapshots.manifest(spark, root, "telemetry")
    folder = state["folders"].get(partition, partition) if state else partition
    inner = schemas.SILVER_TELEMETRY
    try:
        rows = spark.read.schema(inner).parquet(f"{root}/telemetry/{folder}")
        return "empty" if rows.isEmpty() else "data"
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return "missing"
        raise


GOLD = {
    "predicciones": schemas.GOLD_PREDICTION,
    "circuitos": schemas.GOLD_RACE,
    "years": T.StructType([T.StructField("year", T.IntegerType())]),
    "equipos": T.StructType([T.StructField("equipo", T.StringType())]),
}


def read_gold(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Gold rows as the writers of this library store them: JSON lines in a folder named `kind`
    under `path`. A path without that folder is an error."""
    return spark.read.schema(GOLD[kind]).json(f"{path}/{kind}")


def read_document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows inside published documents, one nested object per file: `predicciones` or
    `circuitos`. A document without that key is an error."""
    document = T.StructType([T.StructField(kind, T.ArrayType(GOLD[kind]))])
    nested = spark.read.schema(document).json(path, multiLine=True)
    missing = F.raise_error(F.lit(f"a document has no key {kind}"))
    rows = F.coalesce(F.col(kind), F.when(F.col(kind).isNull(), missing))
    return nested.select(F.inline(rows.cast(T.ArrayType(GOLD[kind]))))


def describe_source(df: DataFrame) -> DataFrame:
    """Columns, types and row count of a table, one row per column."""
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
        )
        for i, field in enumerate(df.schema.fields, 1)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.inline(F.array(*fields)), "rows")

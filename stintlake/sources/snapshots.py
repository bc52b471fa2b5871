"""Published states of a lake table: readers see the old state or the new one, never a mixture.

A write puts its partitions into a folder of its own, `commit=<id>`, beside those of earlier ones.
Then a manifest is added that lists, for every partition, the folder that holds it now: a small file
written under another name and renamed, which fails if a manifest of that number exists. Whatever
step a write dies at, the newest manifest names whole folders; a folder that no manifest names is
invisible. Tables of plain partition folders are read as they are until their first publication,
which takes those folders into its manifest.
"""

import json
import logging
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stintlake import schemas
from stintlake.sources import folders

log = logging.getLogger(__name__)

COMMIT = T.StructField("commit", T.StringType())
#: Other writers that may publish first, before a write gives up.
ATTEMPTS = 20


class Conflict(Exception):
    """A manifest of that number was there already."""


def _manifests(spark: SparkSession, table: str) -> dict[int, str]:
    return {
        int(path.rsplit("/", 1)[1].removesuffix(".json")): path
        for path in folders.listed(spark, f"{table}/_manifests/*.json")
    }


def versions(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the published states, oldest first."""
    return sorted(_manifests(spark, f"{root}/{kind}"))


def manifest(spark: SparkSession, root: str, kind: str, version: int | None = None) -> dict | None:
    """{"version", "folders": {partition: folder}} of a state, the newest by default; None if nothing
    was ever published."""
    found = _manifests(spark, f"{root}/{kind}")
    if version is None and not found:
        return None
    return json.loads(folders.read_text(spark, found[max(found) if version is None else version]))


def _partitions(spark: SparkSession, kind: str, base: str) -> dict[str, str]:
    """The partition folders under a folder, by their partition."""
    names = schemas.SILVER_PARTITIONS[kind]
    pattern = "/".join(f"{name}=*" for name in names)
    return {
        "/".join(path.split("/")[-len(names) :]): path
        for path in folders.listed(spark, f"{base}/{pattern}")
    }


def _relative(path: str, partition: str) -> str:
    """The part of a listed path that lies below the table."""
    before = path.removesuffix(f"/{partition}").rsplit("/", 1)[1]
    return f"{before}/{partition}" if before.startswith("commit=") else partition


def _add(spark: SparkSession, table: str, number: int, entries: dict[str, str]) -> None:
    text = json.dumps({"version": number, "folders": entries}, ensure_ascii=False, sort_keys=True)
    draft = f"{table}/_manifests/.{number}-{uuid4().hex}"
    folders.write_text(spark, draft, text)
    try:
        folders.rename_new(spark, draft, f"{table}/_manifests/{number}.json")
    except FileExistsError as error:
        folders.delete(spark, draft)
        raise Conflict(number) from error


def publish(
    spark: SparkSession, root: str, kind: str, commit: str, races: set[tuple[int, str]] | None = None
) -> int:
    """Makes the partitions in the folder `commit=<commit>` the present ones, and of `races` those
    alone; the number of the new state. If another write gets in first, its changes are kept."""
    table = f"{root}/{kind}"
    new = {
        partition: _relative(path, partition)
        for partition, path in _partitions(spark, kind, f"{table}/commit={commit}").items()
    }
    for _ in range(ATTEMPTS):
        last = manifest(spark, root, kind)
        if last is None:
            plain = _partitions(spark, kind, table)
            last = {"version": 0, "folders": {x: _relative(path, x) for x, path in plain.items()}}
        kept = {
            partition: folder for partition, folder in last["folders"].items()
            if not races or folders.race_of(partition) not in races
        }
        try:
            _add(spark, table, last["version"] + 1, kept | new)
            return last["version"] + 1
        except Conflict:
            log.info("%s: state %d was published meanwhile", kind, last["version"] + 1)
    raise RuntimeError(f"{kind}: others published {ATTEMPTS} times meanwhile")


def values_of(partition: str) -> dict[str, str]:
    return {k: unquote(v) for k, v in (x.split("=", 1) for x in partition.split("/"))}


def read(
    spark: SparkSession, root: str, kind: str, version: int | None = None, only: dict | None = None
) -> DataFrame:
    """A published state, the newest by default. With `only`, values of partition columns, no other
    folders are listed. The files of a state stay as they are, whatever is published later."""
    schema = schemas.SILVER[kind]
    state = manifest(spark, root, kind, version)
    if state is None:
        return spark.read.schema(schema).parquet(f"{root}/{kind}").select(*schema.fieldNames())
    wanted = {k: str(v) for k, v in (only or {}).items()}
    chosen = [
        folder for partition, folder in state["folders"].items()
        if wanted.items() <= values_of(partition).items()
    ]
    reader = spark.read.option("basePath", f"{root}/{kind}")
    committed = T.StructType([*schema.fields, COMMIT])
    found = None
    for kinds, mine in (
        (committed, [x for x in chosen if x.startswith("commit=")]),
        (schema, [x for x in chosen if not x.startswith("commit=")]),
    ):
        if mine:
            part = reader.schema(kinds).parquet(*[f"{root}/{kind}/{x}" for x in mine])
            part = part.select(*schema.fieldNames())
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def vacuum(spark: SparkSession, root: str, kind: str, keep: int = 2) -> list[str]:
    """Deletes the folders that none of the last `keep` states names, and the manifests before
    those. Not to be run while a write is under way; readers of older states fail afterwards."""
    table = f"{root}/{kind}"
    known = versions(spark, root, kind)
    if not known:
        return []
    named = {
        folder for version in known[-keep:]
        for folder in manifest(spark, root, kind, version)["folders"].values()
    }
    gone = []
    for base in [table, *folders.listed(spark, f"{table}/commit=*")]:
        for partition, path in _partitions(spark, kind, base).items():
            if _relative(path, partition) not in named:
                folders.delete(spark, path)
                gone.append(path)
    for version in known[:-keep]:
        folders.delete(spark, f"{table}/_manifests/{version}.json")
    return gone

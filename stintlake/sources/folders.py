"""Listing and deleting folders of the lake, in whatever store Spark reads."""

from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a glob pattern, sorted. Their names come as one text: a call for
    each would take longer than the listing."""
    store, path = _path(spark, pattern)
    found = store.globStatus(path)
    if not found:
        return []
    paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)
    return sorted(spark._jvm.scala.Predef.genericWrapArray(paths).mkString("\0").split("\0"))


def delete(spark: SparkSession, folder: str) -> None:
    store, path = _path(spark, folder)
    store.delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, path = _path(spark, path)
    return store.exists(path)


def read_text(spark: SparkSession, path: str) -> str:
    store, path = _path(spark, path)
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    store, path = _path(spark, path)
    stream = store.create(path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file in one step; FileExistsError if there is one of the new name."""
    store, old = _path(spark, path)
    _, new = _path(spark, to)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(old, new, no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            raise FileExistsError(to) from error
        raise


def race_of(folder: str) -> tuple[int, str]:
    """Year and race of a partition folder."""
    values = dict(x.split("=", 1) for x in folder.split("/") if "=" in x)
    return int(values["Year"]), unquote(values["GrandPrix"])

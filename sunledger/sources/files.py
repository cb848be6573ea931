"""Small file operations of a store folder, on whatever file system it lies."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """File system and its path object."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def is_data(name: str) -> bool:
    return not name.startswith(("_", "."))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds anything to read."""
    fs, hpath = fs_of(spark, path)
    return fs.exists(hpath) and len(fs.listStatus(hpath)) > 0


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, hpath = fs_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a staging folder of this library's own."""
    fs, hpath = fs_of(spark, path)
    fs.delete(hpath, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if it is there already. Of several callers one succeeds."""
    fs, hpath = fs_of(spark, path)
    if fs.getUri().getScheme() == "file":   # Hadoop's local file system looks first and creates then
        local = hpath.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with os.fdopen(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(hpath, False)
    except Py4JJavaError as err:
        if fs.exists(hpath):
            return False
        raise err
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, None if there is none."""
    fs, hpath = fs_of(spark, path)
    try:
        stream = fs.open(hpath)
    except Py4JJavaError:
        if fs.exists(hpath):
            raise
        return None
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_versions(spark: SparkSession, path: str) -> list[int]:
    """Finished ``version=N`` folders below ``path``."""
    fs, _ = fs_of(spark, path)
    done = [n for n in names_in(spark, path) if n.startswith("version=") and fs.exists(fs_of(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix("version=")) for n in done)

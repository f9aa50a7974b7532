"""Numbered versions of a folder: a version is seen whole or not at all.

Data lies in folders of its own; a version is one small file in ``_versions`` that names them. The file is written under another name
and renamed, which fails if the number is taken, so readers always find one whole version and two writers never share a number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all versions, in order."""
    files, path = _files(spark, folder)
    at = path(f"{folder}/_versions")
    if not files.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())


def read(spark: SparkSession, folder: str, number: int) -> dict:
    """What a version says."""
    return json.loads(spark.read.text(f"{folder}/_versions/{number:012d}", wholetext=True).first()[0])


def commit(spark: SparkSession, folder: str, number: int, says: dict) -> None:
    """Makes a version visible."""
    files, path = _files(spark, folder)
    draft, final = path(f"{folder}/_versions/.draft-{uuid.uuid4().hex}"), path(f"{folder}/_versions/{number:012d}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(says).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise FileExistsError(f"version {number} of {folder} is there already")


def forget(spark: SparkSession, folder: str, name: str) -> None:
    """Removes data that no version names any more."""
    files, path = _files(spark, folder)
    files.delete(path(f"{folder}/{name}"), True)

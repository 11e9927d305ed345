"""Small notes beside a table, each of which replaces the one before at once: what a long job means to do, and how far it has come."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from tidelog.sources.files import files_at


def _numbers(files, place) -> list[int]:
    names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n[5:-5]) for n in names if n.startswith("note-") and n.endswith(".json"))


def read(spark: SparkSession, folder: str) -> Any:
    """The last note in ``folder``, or None."""
    files, place = files_at(spark, folder)
    found = _numbers(files, place)
    if not found:
        return None
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/note-{found[-1]}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write(spark: SparkSession, folder: str, content: Any) -> None:
    """Note ``content``: it is written aside, and becomes the last note by a rename; earlier ones go."""
    files, place = files_at(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    before = _numbers(files, place)
    aside, there = path(f"{folder}/aside"), path(f"{folder}/note-{before[-1] + 1 if before else 0}.json")
    out = files.create(aside, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if not files.rename(aside, there):
        raise OSError(f"{folder} can't be noted in")
    for n in before:
        files.delete(path(f"{folder}/note-{n}.json"), False)


def clear(spark: SparkSession, folder: str) -> None:
    files, place = files_at(spark, folder)
    files.delete(place, True)

"""Tables that are refreshed together: each refresh is a version of its own, and one record makes it the current one.

Writers put their tables into a new folder and commit the record last; readers resolve the latest record. A refresh that fails
on the way leaves a folder that no record names, so readers go on with the version before.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from starboard.session import hadoop_path as _path

RECORDS = "_versions"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that was to come next."""


def new_version(spark: SparkSession, folder: str) -> str:
    """A folder in ``folder`` for the tables of one refresh."""
    return f"{folder}/version-{uuid.uuid4().hex}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the records, oldest first."""
    path, files = _path(spark, f"{folder}/{RECORDS}")
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)[.]json", n)))


def _record(spark: SparkSession, folder: str, number: int) -> dict[str, str] | None:
    """The tables of a version by name; None while its record is still being written."""
    path, files = _path(spark, f"{folder}/{RECORDS}/{number}.json")
    stream = files.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def commit(spark: SparkSession, folder: str, version: str, tables: list[str]) -> int:
    """Make the tables in the folder ``version`` the current ones, all at once; return the record's number.

    If another writer commits in between, the tables are those of the later one.
    """
    while True:
        after = max(versions(spark, folder), default=0)
        try:
            return commit_paths(spark, folder, {name: f"{version}/{name}" for name in tables}, after)
        except ConcurrentCommit:
            continue


def commit_paths(spark: SparkSession, folder: str, tables: dict[str, str], after: int) -> int:
    """Write the record that follows number ``after``: paths by name, which may lie in folders of earlier versions.

    A record is created only if there is none of its number, so that two writers never commit the same one.
    """
    path, files = _path(spark, f"{folder}/{RECORDS}/{after + 1}.json")
    try:
        stream = files.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception):
            raise
        raise ConcurrentCommit(f"another writer has committed version {after + 1} of {folder}") from error
    stream.write(json.dumps(tables).encode())
    stream.close()
    return after + 1


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the tables of the latest whole version, by name. Resolve them once and read all tables from there."""
    return latest(spark, folder)[1]


def latest(spark: SparkSession, folder: str, missing_ok: bool = False) -> tuple[int, dict[str, str]]:
    """Number and tables of the latest whole version."""
    for number in reversed(versions(spark, folder)):
        if (tables := _record(spark, folder, number)) is not None:
            return number, tables
    if missing_ok:
        return 0, {}
    raise FileNotFoundError(f"no version in {folder}")


def remove_old(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all but the latest ``keep`` versions, record first, and folders that no record names; return the numbers.

    Call it when no writer is at work, and readers of older versions are done.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    numbers = versions(spark, folder)
    old = numbers[:-keep]
    for number in old:
        path, files = _path(spark, f"{folder}/{RECORDS}/{number}.json")
        files.delete(path, False)
    paths = [p for n in numbers[-keep:] for p in (_record(spark, folder, n) or {}).values()]
    named = {part for p in paths for part in p.split("/") if part.startswith("version-")}
    path, files = _path(spark, folder)
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in named:
            files.delete(status.getPath(), True)
    return old

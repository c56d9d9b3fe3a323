"""Versions of a table in any store: written whole or not seen.

A writer puts a version's files under a fresh name and then creates the marker `commits/N` with that
name in it. The marker must not exist yet, so of two writers one gets N and the other is told to try
again; readers only see names in markers. A marker that a lost writer left empty takes up its number
and names nothing. The store must create a file only where there is none, as file systems do that Spark
commits to.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

from .shared import file_system, remove


def _marker(path: str, version: int) -> str:
    return f"{path}/commits/{version:08d}"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """All numbers that are taken, in order."""
    folder, files = file_system(spark, f"{path}/commits")
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n) for n in found if n.isdigit())


def name_of(spark: SparkSession, path: str, version: int) -> str | None:
    """The name that a version stands under; None for a number that names nothing."""
    marker, files = file_system(spark, _marker(path, version))
    if not files.exists(marker):
        return None
    stream = files.open(marker)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return name or None


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed versions and their names, oldest first."""
    return {n: name for n in numbers(spark, path) if (name := name_of(spark, path, n))}


def fresh() -> str:
    return uuid4().hex


def commit(spark: SparkSession, path: str, version: int, name: str) -> bool:
    """Make `name` the version's; False if the number is taken."""
    marker, files = file_system(spark, _marker(path, version))
    try:
        stream = files.create(marker, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    stream.write(bytearray(name.encode()))
    stream.close()
    return True


def append(spark: SparkSession, path: str, name: str) -> int:
    """Commit `name` under the next free number."""
    version = max(numbers(spark, path), default=0) + 1
    while not commit(spark, path, version, name):
        version += 1
    return version


def forget(spark: SparkSession, path: str, folders: dict[str, list[str]]) -> None:
    """Delete what stands under names that no version has, such as a lost writer's: folder -> names."""
    kept = set(versions(spark, path).values())
    for folder, names in folders.items():
        for name in names:
            if name not in kept:
                remove(spark, f"{path}/{folder}/{name}")

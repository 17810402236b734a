"""Tables and models that are built once: written aside, then put in place by one rename."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession


def fingerprint(*parts) -> str:
    """A name for what a build depends on, from plain values (numbers, texts, lists, dictionaries)."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def input_state(spark: SparkSession, paths: Sequence[str]) -> list:
    """[path, bytes, files, time of change] of each input, so that a fingerprint changes with them; nothing is listed on the driver."""
    out = []
    for path in paths:
        place, fs = _open(spark, path)
        size = fs.getContentSummary(place)
        out.append([path, size.getLength(), size.getFileCount(), fs.getFileStatus(place).getModificationTime()])
    return out


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Let ``write(folder)`` fill a hidden folder beside ``path`` and rename it to ``path``; whether this call's folder is the one in place.

    What is at ``path`` is whole at any time. If it exists, nothing is written. Of builders that run at once, the first to rename
    wins and the others' folders are deleted: a rename onto a folder either fails or ends inside it under a hidden name that no reader
    sees. A writer that fails leaves nothing at ``path``. The file system's rename has to be atomic (HDFS, local and other POSIX file systems).
    """
    place, fs = _open(spark, path)
    if fs.exists(place):
        return False
    name = f".building-{uuid.uuid4().hex}"
    aside, inside = _path(spark, f"{place.getParent()}/{name}"), _path(spark, f"{place}/{name}")
    try:
        write(aside.toString())
        moved = not fs.exists(place) and fs.rename(aside, place)
        first = moved and not fs.exists(inside)
        if not fs.exists(place):
            raise OSError(f"{aside} could not be renamed to {place}")
        return first
    finally:
        for left in (aside, inside):
            if fs.exists(left):
                fs.delete(left, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _open(spark, path)
    return fs.exists(place)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _open(spark: SparkSession, path: str):
    place = _path(spark, path.rstrip("/"))
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

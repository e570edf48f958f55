"""Which batches of a batch table are whole: one small file per version, written last.

A writer writes the folders of a batch, then its version. Readers start from the latest version,
so they see a batch as a whole or not at all, and a batch that failed anywhere before its version
is done again from the version before. What a version says (`note`) are a few plain values.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

# Versions kept: the latest, and one for readers that began before it.
KEPT = 2


class Version(NamedTuple):
    batch_id: int
    note: dict


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(path: str) -> str:
    return posixpath.join(path, "_versions")


def _ids(spark: SparkSession, path: str) -> list[int]:
    place, fs = _path(spark, _folder(path))
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(name) for name in names if name.isdigit())


def latest(spark: SparkSession, path: str) -> Version | None:
    """The last version of the table at `path`; None before the first."""
    ids = _ids(spark, path)
    if not ids:
        return None
    place, fs = _path(spark, posixpath.join(_folder(path), str(ids[-1])))
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(ids[-1], json.loads(text))


def required(spark: SparkSession, path: str) -> Version:
    version = latest(spark, path)
    if version is None:
        raise LookupError(f"no batch has been written at {path}")
    return version


def publish(spark: SparkSession, path: str, batch_id: int, note: dict) -> None:
    """Make a batch part of the table, and let go of versions that nobody can be reading."""
    draft, fs = _path(spark, posixpath.join(_folder(path), f".{uuid.uuid4().hex}"))
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(note).encode()))
    finally:
        out.close()
    place, _ = _path(spark, posixpath.join(_folder(path), str(batch_id)))
    if not fs.rename(draft, place):
        raise OSError(f"could not publish version {batch_id} of {path}")
    for old in _ids(spark, path)[:-KEPT]:
        remove(spark, posixpath.join(_folder(path), str(old)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the table, if it is there."""
    place, fs = _path(spark, path)
    fs.delete(place, True)

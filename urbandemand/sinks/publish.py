"""Outputs of a place that are switched over together.

A place's folder holds versions, each with all its outputs, and manifests with
rising numbers, of which the last names the version that counts. Outputs are
written beside the old ones; the manifest is written last, under a name of its
own, and moved to its number in one step, once every output wanted is there.
A run that breaks off before leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_VERSIONS, _MANIFESTS = "_versions", "_manifests"


class IncompleteVersion(ValueError):
    """Not all outputs are there."""


class _Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        at = self.path("")
        self.system = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(x.getPath().getName() for x in self.system.listStatus(at)) if self.system.exists(at) else []

    def manifests(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names(_MANIFESTS) if n[:-5].isdigit() and n.endswith(".json"))

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def written(self, name: str, text: str) -> None:
        stream = self.system.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def missing(spark: SparkSession, root: str, version: str, wanted: list[str]) -> list[str]:
    """Outputs of a version that no job has finished."""
    folder = _Folder(spark, root)
    return [x for x in wanted if "_SUCCESS" not in folder.names(f"{_VERSIONS}/{version}/{x}")]


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """The path of each output of the version that counts; none before the first."""
    folder = _Folder(spark, root)
    numbers = folder.manifests()
    if not numbers:
        return {}
    told = json.loads(folder.text(f"{_MANIFESTS}/{numbers[-1]}.json"))
    return {x: f"{folder.root}/{_VERSIONS}/{told['version']}/{x}" for x in told["outputs"]}


def switched(spark: SparkSession, root: str, version: str, wanted: list[str]) -> int:
    """Makes a whole version the one that counts, and gives its manifest's number.

    Of two runs that switch at once, both get a number and the later one counts.
    """
    lacking = missing(spark, root, version, wanted)
    if lacking:
        raise IncompleteVersion(f"{root}: {', '.join(lacking)} of version {version} not written")
    folder = _Folder(spark, root)
    own = f"{_MANIFESTS}/new-{uuid.uuid4().hex}"
    folder.written(own, json.dumps({"version": version, "outputs": wanted}))
    number = (folder.manifests() or [0])[-1] + 1
    while not _moved(folder, own, f"{_MANIFESTS}/{number}.json"):
        number += 1
    return number


def _moved(folder: _Folder, old: str, new: str) -> bool:
    """Whether a file got a name that no other has."""
    return not folder.system.exists(folder.path(new)) and folder.system.rename(folder.path(old), folder.path(new))


def published(spark: SparkSession, root: str, outputs: dict[str, Callable[[str], None]]) -> int:
    """Writes every output (a function of the path to write to) and switches over to them."""
    version = uuid.uuid4().hex
    for name, write in outputs.items():
        write(f"{root.rstrip('/')}/{_VERSIONS}/{version}/{name}")
    return switched(spark, root, version, list(outputs))


def cleared(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes versions that the last ``keep`` manifests don't name and that aren't newer than those; gives their names."""
    folder = _Folder(spark, root)
    numbers = folder.manifests()
    named = {n: json.loads(folder.text(f"{_MANIFESTS}/{n}.json"))["version"] for n in numbers}
    kept = {named[n] for n in numbers[-keep:]} if keep else set()
    old = sorted({named[n] for n in numbers} - kept)
    for version in old:
        folder.system.delete(folder.path(f"{_VERSIONS}/{version}"), True)
    return old

"""Versions of a bundle, published as one file each.

A version is a manifest: for each table the folders that hold it, with the columns of their files.
Tables are written first, then the manifest appears under its number in one rename, which fails where
another writer was faster. Readers resolve one manifest and read only what it names, so they see all
tables of one version whatever is being written meanwhile. On a store whose rename isn't atomic the
manifest is as safe as that store's rename.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Folders inside a bundle's folder; names with an underscore are hidden from Spark's listings.
MANIFESTS, DATA = "_manifests", "_data"


class VersionConflict(Exception):
    """Another writer has published the version that this one was to become."""


@dataclass(frozen=True)
class Part:
    """A folder, relative to the bundle's, and the columns of its files in order with their types
    (None: not known)."""

    folder: str
    columns: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Manifest:
    version: int
    fmt: str
    tables: dict[str, list[Part]] = field(default_factory=dict)


class _Store:
    """The few file operations that publishing takes, on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        made = self.jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            made = self.jvm.org.apache.hadoop.fs.Path(made, part)
        return made

    def inside(self, *parts: str):
        return self.path(self.root.toString(), *parts)

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.inside(*parts))

    def names(self, *parts: str) -> list[str]:
        if not self.exists(*parts):
            return []
        return [status.getPath().getName() for status in self.fs.listStatus(self.inside(*parts))]

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.inside(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, folder: str, name: str) -> None:
        """The file appears whole under its name, or not at all where there is one already."""
        staged = self.inside(folder, f".{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        try:
            context.rename(staged, self.inside(folder, name), self.gateway.new_array(options, 0))
        except Py4JJavaError as error:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise VersionConflict(f"{name} of {self.root.toString()} was published meanwhile") from None
            raise


def _versions(store: _Store) -> list[int]:
    return sorted(int(m[1]) for name in store.names(MANIFESTS) if (m := re.fullmatch(r"(\d{12})\.json", name)))


def _name(version: int) -> str:
    return f"{version:012d}.json"


def exists(spark: SparkSession, path: str) -> bool:
    return _Store(spark, path).exists()


def begin(spark: SparkSession, path: str) -> None:
    """Mark a folder as one whose content counts once a version is published."""
    store = _Store(spark, path)
    store.fs.mkdirs(store.inside(MANIFESTS))


def is_managed(spark: SparkSession, path: str) -> bool:
    return _Store(spark, path).exists(MANIFESTS)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The given version, or the last one; None where none was published."""
    store = _Store(spark, path)
    versions = _versions(store)
    if not versions or (version is not None and version not in versions):
        return None
    found = json.loads(store.read(MANIFESTS, _name(versions[-1] if version is None else version)))
    listed = lambda names: None if names is None else tuple(names)
    tables = {
        table: [Part(p["folder"], listed(p["columns"]), listed(p["types"])) for p in parts]
        for table, parts in found["tables"].items()
    }
    return Manifest(found["version"], found["fmt"], tables)


def publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    _Store(spark, path).publish(json.dumps(asdict(manifest)), MANIFESTS, _name(manifest.version))


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Drop all versions but the last ``keep`` and the data that only they name; returns those kept.

    Data of a write that hasn't published yet would go too: call it when nobody writes.
    """
    store = _Store(spark, path)
    versions = _versions(store)
    kept = versions[-max(keep, 1) :]
    used = {part.folder for v in kept for parts in read_version(spark, path, v).tables.values() for part in parts}
    for version in versions:
        if version not in kept:
            store.fs.delete(store.inside(MANIFESTS, _name(version)), False)
    for name in store.names(DATA):
        if not any(folder.startswith(f"{DATA}/{name}/") for folder in used):
            store.fs.delete(store.inside(DATA, name), True)
    return kept

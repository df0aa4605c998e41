"""Store of trainings.

A training is written to a run folder of its own and becomes visible by one
step: its manifest, complete under a temporary name, is renamed into the
folder of its key.  The key is a digest of what the fit uses and of the
version of every table it reads, so changed inputs or parameters never meet
an old model.  Of two writers with one key the first manifest counts and the
later run is taken away by its writer; a run without a manifest, as a lost
driver leaves it, is never read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession, path: str):
    """Hadoop path and file system of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_version(df: DataFrame) -> str:
    """Version of a table without reading it: what it is computed as, and the
    path, size and time of every file below it."""
    spark, folders, files = df.sparkSession, {}, []
    for f in df.inputFiles():
        folders.setdefault(f.rsplit("/", 1)[0], set()).add(f)
    for folder, names in sorted(folders.items()):
        p, fs = folder_of(spark, folder)
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if any(n.endswith("/" + name) for n in names):
                files.append((f"{folder}/{name}", status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr((df.semanticHash(), sorted(files))).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Manifest:
    """What a published training is."""

    key: str
    run: str
    created: int
    tag: str
    inputs: dict
    parameters: str

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, indent=1)


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def key(tag: str, parameters: str, inputs: dict[str, str]) -> str:
        return hashlib.sha256(repr((tag, parameters, sorted(inputs.items()))).encode()).hexdigest()[:24]

    def new_run(self) -> str:
        return f"{self.root}/runs/{uuid.uuid4().hex}"

    def manifests(self, key: str | None = None) -> list[Manifest]:
        """Published trainings, the first one of each key only, oldest first."""
        top, fs = folder_of(self.spark, f"{self.root}/published")
        if not fs.exists(top):
            return []
        keys = [key] if key else [s.getPath().getName() for s in fs.listStatus(top)]
        found = []
        for k in keys:
            folder, _ = folder_of(self.spark, f"{self.root}/published/{k}")
            names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
            names = [n for n in names if n.endswith(".json")]
            if names:
                lines = self.spark.read.text(f"{self.root}/published/{k}/{names[0]}", wholetext=True).first()[0]
                found.append(Manifest(**json.loads(lines)))
        return sorted(found, key=lambda m: (m.created, m.run))

    def find(self, key: str) -> Manifest | None:
        got = self.manifests(key)
        return got[0] if got else None

    def latest(self) -> Manifest:
        got = self.manifests()
        if not got:
            raise FileNotFoundError(f"no published training in {self.root}")
        return got[-1]

    def publish(self, m: Manifest) -> Manifest:
        """Make a finished run visible; returns the training that counts for its key."""
        name = f"{m.created:015d}-{uuid.uuid4().hex}"
        folder, fs = folder_of(self.spark, f"{self.root}/published/{m.key}")
        fs.mkdirs(folder)
        hidden, _ = folder_of(self.spark, f"{self.root}/published/{m.key}/_{name}.tmp")
        out = fs.create(hidden, False)
        out.write(bytearray(m.text().encode()))
        out.close()
        final, _ = folder_of(self.spark, f"{self.root}/published/{m.key}/{name}.json")
        if not fs.rename(hidden, final):
            raise OSError(f"could not publish {m.run}")
        first = self.find(m.key)
        if first.run != m.run:  # another writer was first
            fs.delete(final, False)
            run, _ = folder_of(self.spark, m.run)
            fs.delete(run, True)
        return first

    def withdraw(self, key: str) -> None:
        """Take the manifests of ``key`` away: its training is not found any more."""
        folder, fs = folder_of(self.spark, f"{self.root}/published/{key}")
        fs.delete(folder, True)


def now() -> int:
    return int(time.time() * 1000)

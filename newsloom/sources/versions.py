"""Numbered descriptions of a folder's current content, each published once."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from newsloom.runtime import file_system


class ConcurrentWrite(RuntimeError):
    """Another writer has published since the base version was read."""


class Versions:
    """Descriptions ``root/versions/<number>.json``; the highest number holds.

    A description is written under another name and then renamed, which fails if the number is taken: readers
    see whole descriptions only, there is always one once the first is published, and of two writers
    with the same base the second is refused. Files that a description names are never changed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = os.path.join(self.root, "versions")

    def latest(self) -> tuple[int, dict]:
        """Number and description; (0, {}) if there is none."""
        system, folder = file_system(self.spark, self.folder)
        if not system.exists(folder):
            return 0, {}
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        numbers = [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]
        if not numbers:
            return 0, {}
        number = max(numbers)
        stream = system.open(self._path(f"{self.folder}/{number:012d}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, base: int, description: dict) -> int:
        """Publish ``description`` as the version after ``base``; raises if there is one already."""
        system, folder = file_system(self.spark, self.folder)
        system.mkdirs(folder)
        fresh, target = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{base + 1:012d}.json")
        stream = system.create(fresh, False)
        stream.write(bytearray(json.dumps(description).encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(fresh), context.makeQualified(target), never)
        except Exception as error:
            system.delete(fresh, False)
            if system.exists(target):
                raise ConcurrentWrite(f"version {base + 1} of {self.root} was published by another writer") from error
            raise
        return base + 1

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

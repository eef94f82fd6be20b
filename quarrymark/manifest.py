"""Numbered manifests: a version of a table exists once its file does, whole or not at all.

A manifest is written aside and renamed to its number, which fails where the number is taken, so of two
writers one must look again. The file system has to rename atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .scratch import file_system


class Conflict(Exception):
    """Another writer took the version."""


class Manifests:
    """The manifests of one table, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path, self._files = file_system(spark, folder)

    def versions(self) -> list[int]:
        if not self._files.exists(self._path):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        path, files = file_system(self.spark, f"{self.folder}/{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest version and its content; 0 and nothing before the first."""
        known = self.versions()
        return (known[-1], self.read(known[-1])) if known else (0, {})

    def commit(self, version: int, content: dict) -> None:
        """Makes the content the given version, or raises Conflict where there is one."""
        jvm = self.spark._jvm
        aside, files = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        final, _ = file_system(self.spark, f"{self.folder}/{version:012d}.json")
        stream = files.create(aside, False)
        stream.write(json.dumps(content, ensure_ascii=False).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            context.rename(aside, final, never_over)
        except Py4JJavaError as error:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"version {version} exists") from None
            raise

    def change(self, next_content: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Commits what ``next_content`` makes of the latest content, again where another writer came first; no change for None."""
        for _ in range(tries):
            version, content = self.latest()
            changed = next_content(content)
            if changed is None:
                return version
            try:
                self.commit(version + 1, changed)
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers came first")

    def forget(self, before: int) -> None:
        """Removes manifests older than the given version."""
        for version in self.versions():
            if version < before:
                path, files = file_system(self.spark, f"{self.folder}/{version:012d}.json")
                files.delete(path, False)

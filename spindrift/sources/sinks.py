"""Results as files, and commits of several tables at once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def snapshot(df: DataFrame, folder: str, number: int) -> str:
    """Write the next state of a table beside the earlier ones; a repeated write of a number replaces it."""
    path = f"{folder}/{number}"
    df.write.mode("overwrite").parquet(path)
    return path


class LostWriter(RuntimeError):
    """Another writer committed first; nothing of this commit is visible."""


class Tables:
    """Named tables under one folder that change together.

    A commit writes its tables to a folder of their own and then one small manifest, `v<number>.json`, which must not be
    there yet: of two writers that began from one version the second finds it and is lost, its files are deleted, and
    readers never see a part of it. Tables that a commit does not name stay as they were. The folder is any that Spark's
    file systems know.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The number of the latest commit, 0 before any."""
        if not self._fs.exists(self._path("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._manifest(self.version() if version is None else version)[name]}")

    def names(self) -> list[str]:
        return sorted(self._manifest(self.version()))

    def commit(self, tables: dict[str, DataFrame], began: int) -> int:
        """Publish tables as the version after `began`, the one that the writer read; LostWriter if that is taken."""
        if self.version() != began:  # the manifest decides; this only spares a late writer its work
            raise LostWriter(f"{self.folder} has another version than {began}")
        own = f"data-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.folder}/{own}/{name}")
            manifest = self._manifest(began) | {name: f"{own}/{name}" for name in tables}
            self._create(f"v{began + 1}.json", json.dumps(manifest))
        except BaseException:
            self._fs.delete(self._path(own), True)
            raise
        return began + 1

    def _create(self, name: str, content: str) -> None:
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                raise LostWriter(f"{self.folder}/{name} is there already") from e
            raise
        stream.write(bytearray(content.encode()))
        stream.close()


def json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report of at most `most` rows."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    return "\n".join([f"# {title}", "", head, *(f"| {' | '.join('' if x is None else str(x).replace('|', '/') for x in r)} |" for r in rows), ""])

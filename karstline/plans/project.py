"""A project folder: a JSON sidecar, Parquet tables by name, and a read-only flag that guards writes.

All paths go through Hadoop's file systems, so a project may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folders of a project, its sidecar and the schema versions in order.
FOLDERS = ("artifacts", "cache", "logs", "temp")
SIDECAR = "project.json"
MIGRATIONS = (1, 3, 4, 5, 6, 7, 8)


class Project:
    def __init__(self, spark: SparkSession, root: str, info: dict, read_only: bool):
        self.spark, self.root, self.info, self.read_only = spark, root.rstrip("/"), info, read_only

    # -- files

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, *parts: str) -> bool:
        fs, p = self._path(*parts)
        return fs.exists(p)

    def _guard(self) -> None:
        if self.read_only:
            raise PermissionError("the project is read-only")

    # -- life

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, id_: str, **info) -> Project:
        """A new folder with extension .spx; a nil id and an existing folder are errors."""
        if not root.rstrip("/").endswith(".spx"):
            raise ValueError("a project folder needs the extension .spx")
        if not id_ or uuid.UUID(id_).int == 0:
            raise ValueError("the project id must not be nil")
        out = cls(spark, root, {"uuid": id_, "name": name, "schema_version": MIGRATIONS[-1], "flags": {"read_only": False}, **info}, False)
        if out._exists():
            raise FileExistsError(root)
        for folder in FOLDERS:
            fs, p = out._path(folder)
            fs.mkdirs(p)
        out.save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str, read_only: bool = False) -> Project:
        """An existing project; a missing folder, sidecar or part of the layout is an error. A writer
        brings an older schema up to date, a reader leaves it alone."""
        out = cls(spark, root, {}, True)
        if not out._exists():
            raise FileNotFoundError(root)
        if not out._exists(SIDECAR):
            raise ValueError(f"{SIDECAR} not found: the project is incomplete")
        text = "\n".join(r.value for r in spark.read.text(f"{out.root}/{SIDECAR}", wholetext=True).collect())
        try:
            out.info = json.loads(text)
        except json.JSONDecodeError:
            raise ValueError(f"{SIDECAR} is not valid JSON") from None
        for folder in FOLDERS:
            if not out._exists(folder):
                raise ValueError(f"project layout is incomplete (missing {folder})")
        out.read_only = read_only or bool(out.info.get("flags", {}).get("read_only"))
        if not out.read_only:
            out.migrate()
        return out

    def migrate(self) -> int:
        """Number of schema versions applied; none if the project is up to date."""
        self._guard()
        todo = [v for v in MIGRATIONS if v > self.info.get("schema_version", 0)]
        if todo:
            self.info["schema_version"] = todo[-1]
            self.save()
        return len(todo)

    def save(self) -> None:
        """The sidecar is written beside its place and renamed into it."""
        self._guard()
        fs, new = self._path(f".{SIDECAR}.{uuid.uuid4().hex}")
        _, place = self._path(SIDECAR)
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(self.info, indent=2, sort_keys=True).encode()))
        stream.close()
        if fs.exists(place):
            fs.delete(place, False)
        if not fs.rename(new, place):
            raise OSError(f"{SIDECAR} could not be replaced")

    # -- tables

    def write(self, name: str, df: DataFrame) -> None:
        self._guard()
        df.write.mode("append").parquet(f"{self.root}/tables/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/{name}")

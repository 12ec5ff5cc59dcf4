"""Runs by manifest: a version of a run is one small file that names the folder of every table.

Tables are written to folders of their own first; one rename of the manifest, from a name that readers pass over,
makes them a version.  Readers open the tables of the last whole manifest, so they never meet a gap or a half
written table, and a job that fails leaves the last version as it was.  Renaming one small file needs no atomic
renaming of folders.  Kept tables are referred to, by later versions and by derived runs, and never copied; two
writers that commit the same version do not overwrite each other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from segmentflow.sources.sinks import write_table


class CommitConflict(Exception):
    """Another writer has committed this version."""


@dataclass
class Run:
    """A versioned run in a folder; paths are Spark paths."""

    spark: SparkSession
    root: str

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions")
        return jvm, folder.getFileSystem(conf), folder

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_versions/{name}")

    def versions(self) -> list[int]:
        """The numbers of all committed versions, rising."""
        _, files, folder = self._files()
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]  # one small file per version
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "parent", "tables": {name: path}} of a version, the last by default."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "parent": None, "tables": {}}
            version = known[-1]
        if version not in known:
            raise ValueError(f"{self.root} has no version {version}")
        jvm, files, _ = self._files()
        stream = files.open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version."""
        tables = self.manifest(version)["tables"]
        if name not in tables:
            raise ValueError(f"{self.root} has no table {name}")
        return self.spark.read.parquet(tables[name])

    def commit(self, tables: dict[str, DataFrame], by_cycle: bool = True, dropped: tuple[str, ...] = (), base: int | None = None) -> int:
        """Write tables and make them, with all others of the base version, the next version; returns its number.

        ``base`` is the version that the tables were made from, the last by default.  Tables may read those that
        they replace.
        """
        before = self.manifest(base)
        named = {n: p for n, p in before["tables"].items() if n not in dropped}
        for name, df in tables.items():
            folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
            write_table(df, folder, "data", by_cycle, mode="errorifexists")
            named[name] = f"{folder}/data"
        return self._publish({"version": before["version"] + 1, "parent": before["version"], "tables": named})

    def derive(self, target: str, kept: list[str], replaced: dict[str, DataFrame], by_cycle: bool = True) -> "Run":
        """A new run whose first version refers to the kept tables of this one and has the replaced ones of its own."""
        own, new = self.manifest()["tables"], Run(self.spark, target)
        missing = [n for n in kept if n not in own]
        if missing:
            raise ValueError(f"{self.root} has no table {', '.join(missing)}")
        if new.versions():
            raise CommitConflict(f"{target} is a run already")
        named = {n: own[n] for n in kept}
        for name, df in replaced.items():
            folder = f"{target}/{name}/{uuid.uuid4().hex}"
            write_table(df, folder, "data", by_cycle, mode="errorifexists")
            named[name] = f"{folder}/data"
        new._publish({"version": 1, "parent": None, "source": self.root, "tables": named})
        return new

    def unreferenced(self) -> list[str]:
        """Table folders that no version of this run names, such as those of failed jobs; derived runs are not looked at."""
        jvm, files, _ = self._files()
        used = {p for v in self.versions() for p in self.manifest(v)["tables"].values()}
        out = []
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for table in files.listStatus(root) if files.exists(root) else []:
            if table.isDirectory() and not table.getPath().getName().startswith("_"):
                out += [f"{self.root}/{table.getPath().getName()}/{f.getPath().getName()}" for f in files.listStatus(table.getPath())]
        return sorted(p for p in out if f"{p}/data" not in used)

    def _publish(self, manifest: dict) -> int:
        jvm, files, folder = self._files()
        files.mkdirs(folder)
        draft, goal = self._path(f".{uuid.uuid4().hex}"), self._path(f"{manifest['version']:012d}.json")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if files.exists(goal) or not files.rename(draft, goal):
            files.delete(draft, False)
            raise CommitConflict(f"version {manifest['version']} of {self.root} exists")
        return manifest["version"]

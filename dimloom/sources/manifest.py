"""A table that is replaced whole by one small file, on any store.

Data folders are written once and never changed, moved or renamed. What belongs to the table is said by the newest manifest, a small numbered file
that is created last and ends with a mark, so a half-written one does not count. A reader sees the old rows or the new ones, never a mixture or
nothing, and keeps what it has resolved until ``vacuum`` removes old folders. Two writers cannot both create the same number: the later one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.sources.files import Files

END = "\n--end--\n"


class ManifestTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Files(spark, self.path)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        """The numbers of all whole manifests."""
        named = sorted(int(n.removesuffix(".json")) for n in self._files.children(f"{self.path}/manifest") if n.endswith(".json") and n[0].isdigit())
        return [v for v in named if self._files.read_text(self._manifest(v)).endswith(END)]

    def newest(self) -> int | None:
        """The number of the newest whole manifest; only as many are opened as are broken."""
        named = sorted((n for n in self._files.children(f"{self.path}/manifest") if n.endswith(".json") and n[0].isdigit()), reverse=True)
        return next((int(n.removesuffix(".json")) for n in named if self._files.read_text(f"{self.path}/manifest/{n}").endswith(END)), None)

    def content(self, version: int) -> dict:
        return json.loads(self._files.read_text(self._manifest(version)).removesuffix(END))

    def commit(self, folders: list[str], schema: T.StructType) -> int:
        """Make the folders the table. A number that another writer, or one that failed, has taken is passed only if its manifest is broken."""
        newest = self.newest()
        version = (newest or 0) + 1
        while self._files.exists(self._manifest(version)) and not self._files.read_text(self._manifest(version)).endswith(END):
            version += 1
        self._files.create_text(self._manifest(version), json.dumps({"folders": folders, "schema": schema.json()}) + END)
        return version

    def write_data(self, df: DataFrame) -> tuple[str, int]:
        """(a new data folder, rows in it). It belongs to no table until a manifest names it."""
        folder, seen = f"{self.path}/data/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        return folder, seen.get["rows"]

    def replace(self, df: DataFrame) -> int:
        """Replace all rows and return how many there are. A write that fails leaves the table as it was; ``df`` may read the table itself."""
        folder, rows = self.write_data(df)
        self.commit([folder], df.schema)
        return rows

    def append(self, df: DataFrame) -> int:
        version = self.newest()
        old = self.content(version)["folders"] if version else []
        folder, rows = self.write_data(df)
        self.commit([*old, folder], df.schema)
        return rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still kept."""
        version = version or self.newest()
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        held = self.content(version)
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        return self.spark.read.schema(schema).parquet(*held["folders"])

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the newest ``keep``, and folders that none of those names. Not while a write is under way."""
        versions = self.versions()
        kept = {f.rsplit("/", 1)[1] for v in versions[-keep:] for f in self.content(v)["folders"]}
        for v in versions[:-keep]:
            self._files.remove(self._manifest(v))
        for name in self._files.children(f"{self.path}/data"):
            if name not in kept:
                self._files.remove(f"{self.path}/data/{name}")

"""Tables that change together: layers of Parquet below one folder, and numbered manifests that say which layers hold."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """A set of tables in which each key is a record: a row of the leading table, with its rows of the others.

    A commit writes a layer, a folder of Parquet for each table, and then a manifest, one small file, under the next number.
    Readers go by the manifest of the greatest number, so that they see all tables of a commit or none: what a failed
    commit wrote is never named. A manifest is renamed into place, which fails if its number is taken; then the commit
    takes the next one, on top of the other writer's layers. In a read, a record of a later layer takes the place of an
    earlier one whole, rows of the other tables too, so that a commit costs what is new, whatever the tables hold already.

    A manifest also has a ledger: the last batch of each source that is in the tables. A batch that comes again is left out.
    Sources number their batches in ascending order. The folder may be in any file system of Spark's, so far as renames
    to a name that is taken fail there.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "voucher_id", leader: str = "master"):
        self.spark, self.folder, self.key, self.leader = spark, folder.rstrip("/"), key, leader
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        at = self._path("manifests")
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs().listStatus(at) if f.getPath().getName()[0].isdigit()) if self._fs().exists(at) else []

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest came into place under its number."""
        fs, hadoop = self._fs(), self._jvm.org.apache.hadoop.fs
        fs.mkdirs(self._path("manifests"))
        draft, place = self._path("manifests", f".draft-{uuid.uuid4().hex}"), self._path("manifests", f"{manifest['version']:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(draft), fs.makeQualified(place), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    # --- manifests ---

    def versions(self) -> list[int]:
        return self._numbers()

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; one without layers if there is none."""
        if version is None:
            found = self._numbers()
            if not found:
                return {"version": 0, "layers": [], "applied": {}}
            version = found[-1]
        stream = self._fs().open(self._path("manifests", f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def applied(self, source: str) -> int:
        """The number of the source's last batch in the tables; -1 if there is none."""
        return self.manifest()["applied"].get(source, -1)

    # --- writes ---

    def _layer(self, tables: dict[str, DataFrame]) -> str:
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(f"{self.folder}/layers/{name}/{table}")
        return name

    def commit(self, tables: dict[str, DataFrame], source: str | None = None, batch: int | None = None) -> int:
        """Upserts the records of tables, all of them or none; returns the version that has them.

        Nothing is written if the ledger has this batch of the source, or a later one.
        """
        if source is not None and batch <= self.applied(source):
            return self.manifest()["version"]
        if self.leader not in tables:
            raise ValueError(f"a commit needs the table {self.leader}")
        layer = self._layer(tables)
        while True:
            now = self.manifest()
            if now["layers"] and set(now["tables"]) != set(tables):
                raise ValueError(f"the tables here are {now['tables']}")
            if source is not None and batch <= now["applied"].get(source, -1):
                return now["version"]
            applied = now["applied"] | ({} if source is None else {source: batch})
            if self._put({"version": now["version"] + 1, "tables": sorted(tables), "layers": [*now["layers"], layer], "applied": applied}):
                return now["version"] + 1

    def compact(self) -> int:
        """One layer in the place of those that are there; layers that others commit meanwhile stay on top of it."""
        before = self.manifest()
        if len(before["layers"]) < 2:
            return before["version"]
        layer = self._layer(self.read(before["version"]))
        while True:
            now = self.manifest()
            if now["layers"][: len(before["layers"])] != before["layers"]:
                return now["version"]  # another writer was first
            if self._put(now | {"version": now["version"] + 1, "layers": [layer, *now["layers"][len(before["layers"]) :]]}):
                return now["version"] + 1

    def expire(self, keep: int = 2) -> None:
        """Removes all but the last manifests, and the layers that none of those names. No commit may be under way."""
        numbers, fs = self._numbers(), self._fs()
        held = {layer for n in numbers[-keep:] for layer in self.manifest(n)["layers"]}
        for n in numbers[:-keep]:
            fs.delete(self._path("manifests", f"{n:012d}.json"), False)
        if fs.exists(self._path("layers")):
            for f in fs.listStatus(self._path("layers")):
                if f.getPath().getName() not in held:
                    fs.delete(f.getPath(), True)

    # --- reads ---

    def _rows(self, at: dict) -> dict[str, DataFrame]:
        """All rows of all layers, with the layer's place in _layer."""
        if not at["layers"]:
            raise ValueError(f"nothing was committed to {self.folder}")
        out = {}
        for table in at["tables"]:
            parts = [self.spark.read.parquet(f"{self.folder}/layers/{layer}/{table}").withColumn("_layer", F.lit(n)) for n, layer in enumerate(at["layers"])]
            out[table] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return out

    def every(self, version: int | None = None) -> dict[str, DataFrame]:
        """All rows that were committed, whatever replaced them."""
        return {table: rows.drop("_layer") for table, rows in self._rows(self.manifest(version)).items()}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables as of a version. One layer is read as it is; of several the latest of each record is kept, by the key."""
        at = self.manifest(version)
        out = self._rows(at)
        if len(at["layers"]) == 1:
            return {table: rows.drop("_layer") for table, rows in out.items()}
        latest = out[self.leader].groupBy(F.col(self.key).alias("_key")).agg(F.max("_layer").alias("_last"))
        holds = F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_layer") == F.col("_last"))
        return {table: rows.join(latest, holds, "left_semi").drop("_layer") for table, rows in out.items()}

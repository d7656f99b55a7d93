"""Size-tiered sharding: small immutable shards, merged by similar size, under a versioned manifest.

Every append writes new files and commits a manifest version that lists them. Compaction takes each size tier
(powers of `fan_in`) that holds at least `fan_in` shards below the target, merges them into files of about the
target size, and commits a version that lists the new files in place of the old. A version is a file of its own
that appears by a rename that fails if the name exists, so of two writers one sees its commit refused, reads the
newer version and tries again; readers see a whole version or the one before. Files that no kept version lists,
such as those of failed tasks, are removed by vacuum().

The rows go through DataFrame reads and writes only. The driver handles names and sizes of files, one entry per
shard. Shards are merged without a shuffle: whole files are dealt to as many tasks as there are files to write.

Defined cases: rows are kept as they are, null values and repeated rows included; any columns are allowed but
must be the same for every append, else ValueError; an empty append commits a version with its (row-less) files;
an empty store reads as an empty table once a schema is known.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import _hadoop


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 256 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    def _list(self, folder: str) -> list[tuple[str, int]]:
        fs, p = _hadoop(self.spark, folder)
        if not fs.exists(p):
            return []
        return sorted((str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(p) if s.isFile())

    def versions(self) -> list[int]:
        return [int(name.rpartition("/v")[2].removesuffix(".json")) for name, _ in self._list(f"{self.root}/manifest") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """A version's content: version, schema (JSON), shards (path and bytes)."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = _hadoop(self.spark, f"{self.root}/manifest/v{version or max(known):012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, schema: str, shards: list[dict]) -> None:
        fs, temp = _hadoop(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(json.dumps({"version": version, "schema": schema, "shards": shards}).encode())
        out.close()
        jvm = self.spark._jvm
        name = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(temp).toUri(), fs.getConf())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(name), none)
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from e
            raise

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return [{"path": p, "bytes": n} for p, n in self._list(folder) if p.endswith(".parquet")]

    def append(self, df: DataFrame, attempts: int = 10) -> int:
        """Write df's partitions as new shards; returns the version that lists them."""
        schema, shards = df.schema.json(), None
        for _ in range(attempts):
            now = self.manifest()
            if now["schema"] not in (None, schema):
                raise ValueError("the columns differ from the store's")
            shards = self._write(df) if shards is None else shards
            try:
                self._commit(now["version"] + 1, schema, now["shards"] + shards)
                return now["version"] + 1
            except CommitConflict:
                continue
        raise CommitConflict("gave up")

    def _tier(self, size: int) -> int:
        return int(math.log(max(size, 1)) / math.log(self.fan_in))

    def compact(self, *, everything: bool = False) -> int:
        """Merge tiers until none is full; returns the version. everything: merge also the tiers that are not full."""
        while True:
            now = self.manifest()
            small = [s for s in now["shards"] if s["bytes"] < self.target * 3 // 4]
            tiers: dict[int, list[dict]] = {}
            for s in small:
                tiers.setdefault(0 if everything else self._tier(s["bytes"]), []).append(s)
            full = [t for _, t in sorted(tiers.items()) if len(t) >= (2 if everything else self.fan_in)]
            if not full:
                return now["version"]
            run = full[0]
            files = max(1, round(sum(s["bytes"] for s in run) / self.target))
            if files >= len(run):
                return now["version"]
            merged = self._write(self._read(run, now["schema"]).coalesce(files))
            gone = {s["path"] for s in run}
            while True:
                if not gone <= {s["path"] for s in now["shards"]}:
                    break  # another compaction took some of them: its version stands, ours is left to vacuum
                try:
                    self._commit(now["version"] + 1, now["schema"], [s for s in now["shards"] if s["path"] not in gone] + merged)
                    break
                except CommitConflict:
                    now = self.manifest()
            if everything:
                return self.manifest()["version"]

    def _read(self, shards: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(s["path"] for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was ever appended")
        return self._read(now["shards"], now["schema"])

    def vacuum(self, keep: int = 1) -> int:
        """Remove the manifests before the last `keep` and the files that no kept one lists; returns the files removed.

        To be run while no other writer is at work."""
        versions = sorted(self.versions())
        kept = {s["path"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        for v in versions[:-keep]:
            fs, p = _hadoop(self.spark, f"{self.root}/manifest/v{v:012d}.json")
            fs.delete(p, False)
        fs, data = _hadoop(self.spark, f"{self.root}/data")
        gone = 0
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            own = self._list(folder.getPath().toString())
            dead = [p for p, _ in own if p not in kept and not p.rpartition("/")[2].startswith(("_", "."))]
            gone += len(dead)
            if not any(p in kept for p, _ in own):
                fs.delete(folder.getPath(), True)
            else:
                for p in dead:
                    fs.delete(_hadoop(self.spark, p)[1], False)
        return gone

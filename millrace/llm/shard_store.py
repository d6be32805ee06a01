"""A store of immutable Parquet shards, compacted by size tiers.

Arrivals are appended as runs of small shards. Runs of similar size (one tier spans a factor of FANOUT)
are merged, FANOUT or more at a time, into files of about the target size. What the store holds is what its newest
manifest says: a JSON file with a version number, written beside and then renamed into place, which
fails if that version is there already; the writer then does the same on top of the newer version. Readers
see the old version or the new one. A writer that died leaves files that no manifest names; ``vacuum`` deletes
them once they are old enough not to be those of a writer that is about to commit.

Cases: an empty arrival adds a version without a run; null and repeated rows, very long texts and any columns are
stored as they are; a null arrival key is a run of its own; reading an empty store needs a schema.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Runs below this size are all of the lowest tier.
LEAST_BYTES = 1 << 20
#: Times that a commit is tried on top of newer versions.
TRIES = 100
#: Seconds after which a run that no manifest names counts as abandoned.
ABANDONED = 86_400


@dataclass(frozen=True)
class Run:
    name: str
    files: tuple[str, ...]
    size: int

    def tier(self, fanout: int = FANOUT) -> int:
        return max(0, math.floor(math.log(max(self.size, 1) / LEAST_BYTES, fanout)) + 1) if self.size >= LEAST_BYTES else 0


class Conflict(RuntimeError):
    """Another writer committed that version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(r["name"], tuple(r["files"]), r["size"]) for r in json.loads(text)["runs"]]

    def commit(self, base: int, runs: list[Run]) -> int:
        """Makes ``runs`` version base + 1, all or nothing."""
        jvm, version = self.spark._jvm, base + 1
        final, beside = (self._path(f"{self.root}/manifests/{n}") for n in (f"v{version:08d}.json", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(beside, True)
        stream.write(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(beside, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def publish(self, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commits what ``change`` makes of the newest version's runs, again if another writer was first; None if it makes nothing of them."""
        for _ in range(TRIES):
            base = max(self.versions(), default=0)
            try:
                runs = self.runs(base)
            except Exception:
                if base in self.versions():
                    raise
                continue  # a newer version has replaced it
            after = change(runs)
            if after is None:
                return None
            try:
                return self.commit(base, after)
            except Conflict:
                time.sleep(random.random() / 10)
        raise Conflict(f"{TRIES} versions of other writers came first")

    # Runs

    def _listed(self, name: str, sub: str = "") -> Run | None:
        at = self._path(f"{self.root}/runs/{name}{sub}")
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".parquet")] if self._fs.exists(at) else []
        return Run(name + sub, tuple(sorted(n for n, _ in found)), sum(size for _, size in found)) if found else None

    def append(self, df: DataFrame) -> int:
        """One arrival as one run."""
        name = uuid.uuid4().hex[:16]
        df.write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
        run = None if self.spark.read.schema(df.schema).parquet(f"{self.root}/runs/{name}").isEmpty() else self._listed(name)
        return self.publish(lambda runs: [*runs, *([run] if run else [])])

    def append_arrivals(self, df: DataFrame, arrival: str) -> int:
        """Every arrival (value of a column, which is kept) as a run of its own, in one pass and one commit."""
        name, by, taken = uuid.uuid4().hex[:16], "__run", {c.lower() for c in df.columns}
        while by in taken:
            by += "_"
        df.withColumn(by, F.col(arrival)).write.option("compression", "zstd").partitionBy(by).parquet(f"{self.root}/runs/{name}")
        at = self._path(f"{self.root}/runs/{name}")
        subs = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory())
        new = [r for s in subs if (r := self._listed(name, f"/{s}"))]
        return self.publish(lambda runs: [*runs, *new])

    def frame(self, runs: list[Run], schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        paths = [f"{self.root}/runs/{r.name}/{f}" for r in runs for f in r.files]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        return self.frame(self.runs(version), schema)

    def due(self) -> list[Run]:
        """The lowest tier with FANOUT runs or more."""
        tiers: dict[int, list[Run]] = {}
        for r in self.runs():
            tiers.setdefault(r.tier(self.fanout), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges tiers until none is full; each merge is a commit. Returns the number of merges."""
        merges = 0
        while old := self.due():
            name = uuid.uuid4().hex[:16]
            files = max(1, round(sum(r.size for r in old) / self.target))
            self.frame(old).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
            gone, merged = {r.name for r in old}, self._listed(name)
            done = self.publish(lambda runs: [*(r for r in runs if r.name not in gone), merged] if gone <= {r.name for r in runs} else None)
            if done is None:  # another writer has merged some of them
                remove(self.spark, f"{self.root}/runs/{name}")
            else:
                merges += 1
        return merges

    def vacuum(self, keep: int = 1, abandoned: float = ABANDONED) -> None:
        """Deletes the versions but the newest ``keep`` and the runs that only they name, and runs that no version has named for ``abandoned`` seconds."""
        versions = self.versions()
        named = {r.name for v in versions[-keep:] for r in self.runs(v)}
        old = {r.name for v in versions[:-keep] for r in self.runs(v)} - named
        at, before = self._path(f"{self.root}/runs"), (time.time() - abandoned) * 1000
        for top in self._fs.listStatus(at) if self._fs.exists(at) else []:
            name = top.getPath().getName()
            subs = [(f"{name}/{s.getPath().getName()}", s) for s in self._fs.listStatus(top.getPath()) if s.isDirectory()] if top.isDirectory() else []
            for run, status in subs or [(name, top)]:
                if run in old or run not in named and status.getModificationTime() <= before:
                    remove(self.spark, f"{self.root}/runs/{run}")
        for v in versions[:-keep]:
            remove(self.spark, f"{self.root}/manifests/v{v:08d}.json")

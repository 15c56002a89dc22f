"""A log of keys that grows by batches and stays small in files: runs in levels, merged by size."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.sources.scratch import exists, remove

#: Parts by hash that the keys of a merged run lie in, and runs of a level that become one of the next.
PARTS, FAN = 256, 8
KEY = "key string, part int"


def part_of(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class KeyLog:
    """Keys under a folder: ``level=n/run=name``, where a run is whole when its _SUCCESS is there.

    A batch adds one run at level 0, a few files whatever its parts. FAN runs of a level are merged
    into one of the next, in PARTS folders by hash, of which a reader opens those that it asks for.
    So b batches leave at most FAN runs at each of log(b) levels, and each key is rewritten once a
    level. A merge takes committed batches only: their runs' keys cannot be asked to leave the log
    again. It is named by what it merges: when it is broken off it is made again or, if it was whole,
    only its sources go. Keys are a set, so until then nothing is wrong with having both.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _folders(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def runs(self) -> list[tuple[int, str]]:
        """(level, run) of all whole runs."""
        levels = [x for x in self._folders(self.folder) if x.startswith("level=")]
        named = [(int(x[6:]), y[4:]) for x in levels for y in self._folders(f"{self.folder}/{x}") if y.startswith("run=")]
        return sorted(r for r in named if exists(self.spark, f"{self.path(*r)}/_SUCCESS"))

    def path(self, level: int, run: str) -> str:
        return f"{self.folder}/level={level}/run={run}"

    def read(self, runs: list[tuple[int, str]], parts: list[int] | None = None) -> DataFrame:
        """(key, part) of the runs; of merged runs only the folders of the parts are read."""
        found = self.spark.createDataFrame([], KEY)
        flat = [self.path(*r) for r in runs if r[0] == 0]
        merged = [self.path(*r) for r in runs if r[0] > 0]
        if flat:
            found = found.unionByName(self.spark.read.schema(KEY).parquet(*flat))
        if merged:
            found = found.unionByName(self.spark.read.option("basePath", self.folder).schema(f"{KEY}, level int, run string").parquet(*merged).select("key", "part"))
        return found if parts is None else found.where(F.col("part").isin(parts))

    def known(self, parts: list[int], but: str) -> DataFrame:
        """(key) of the parts, without the run ``but`` of level 0."""
        return self.read([r for r in self.runs() if r != (0, but)], parts).select("key")

    def add(self, keys: DataFrame, run: str) -> None:
        """Write keys (key, part) as a run of level 0, in place of one of its name."""
        keys.write.mode("overwrite").parquet(self.path(0, run))

    def compact(self, but: str) -> None:
        """Merge levels that are full. ``but`` is the run of the batch at hand, which may be run again and stays as it is."""
        level = 0
        while True:
            runs = self.runs()
            own = [r for r in runs if r[0] == level and r != (0, but)]
            if not any(n >= level for n, _ in runs):
                return
            while len(own) >= FAN:
                merged, own = own[:FAN], own[FAN:]
                name = hashlib.sha256("\n".join(n for _, n in merged).encode()).hexdigest()[:32]
                if (level + 1, name) not in runs:
                    rows = self.read(merged).dropDuplicates(["key"]).repartition("part")
                    rows.write.mode("overwrite").partitionBy("part").parquet(self.path(level + 1, name))
                for r in merged:
                    self.drop(r)
            level += 1

    def drop(self, run: tuple[int, str]) -> None:
        remove(self.spark, self.path(*run))

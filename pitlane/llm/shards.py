"""Sharding by size-tiered compaction over immutable runs and a versioned manifest.

A store is a folder: ``data/<run>/`` holds the Parquet files of one run, ``manifest/v<version>/`` the
table of files that make up the store at that version. Arrivals are appended as small runs. Runs of
similar size belong to one tier (powers of ``fan_in`` over ``base_bytes``); once a tier has ``fan_in``
runs, they are merged into one run of files of about ``target_bytes``, read and written without a
shuffle. Neither step changes a file that exists.

A version is written aside and then renamed into its place by a rename that refuses to replace, which
HDFS and local disks do atomically: a writer that comes second fails and has changed nothing, a reader
sees a version whole or not at all, and what a lost job leaves is in no manifest. (An object store
needs a committer or a catalogue for that step.)
"""

from __future__ import annotations

import math
import time
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = r"/data/([^/]+)/[^/]+$"


class ShardStore:
    """A store of rows of one schema at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.base_bytes, self.fan_in = target_bytes, base_bytes, fan_in
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        folder, fs = self._at("manifest"), self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """run, tier, file, bytes, rows, of one version (the newest by default); None if there is none."""
        versions = self.versions()
        if not versions:
            return None
        return self.spark.read.parquet(f"{self.path}/manifest/v{versions[-1] if version is None else version:08d}")

    def runs(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(run, tier, bytes), by name. There are fewer than fan_in in a tier after compact(), so they are few."""
        m = self.manifest(version)
        return [] if m is None else [tuple(r) for r in m.groupBy("run", "tier").agg(F.sum("bytes")).orderBy("run").collect()]

    def _commit(self, files: DataFrame, version: int) -> int:
        aside = f"manifest/.{uuid.uuid4().hex}"
        files.coalesce(1 + version // 1_000).write.parquet(f"{self.path}/{aside}")
        context = self._hadoop.FileContext.getFileContext(self._at().toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._at(aside), self._at("manifest", f"v{version:08d}"), options)
        return version

    def _new_run(self, version: int) -> str:
        """The version that a run is written for, and what tells writers apart."""
        return f"{version:08d}-{uuid.uuid4().hex}"

    def _files(self, run: str) -> DataFrame:
        """Rows of the manifest for a run that is on disk and in no manifest yet."""
        files = self.spark.read.parquet(f"{self.path}/data/{run}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        files = files.groupBy("file", "bytes").agg(F.count("*").alias("rows"))
        whole = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
        return files.select(F.lit(run).alias("run"), F.lit(self._tier(whole)).alias("tier"), "file", "bytes", "rows")

    def _write(self, rows: DataFrame, version: int) -> DataFrame:
        """A new run, in no manifest yet: its files."""
        run = self._new_run(version)
        rows.write.parquet(f"{self.path}/data/{run}")
        return self._files(run)

    def _tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.base_bytes, self.fan_in)))

    def append(self, rows: DataFrame) -> int:
        """Writes an arrival as a run of small shards and commits the next version, whose number it returns.

        Rows are stored as they are, repeated ones and nulls included. An empty arrival commits a
        version that has no new files.
        """
        last = (self.versions() or [0])[-1]
        return self._append(self._write(rows, last + 1), last)

    def _append(self, files: DataFrame | None, last: int) -> int:
        before = self.manifest(last) if last else None
        both = [x for x in (before, files) if x is not None]
        empty = self.spark.createDataFrame([], "run string, tier int, file string, bytes long, rows long")
        return self._commit(both[0].unionByName(both[1]) if len(both) == 2 else (both or [empty])[0], last + 1)

    def append_arrivals(self, rows: DataFrame, arrival: Column, arrivals: int) -> int:
        """Appends rows of arrival 0, 1, ... one after the other, compacting after each; the newest version.

        The rows are read and written once, each arrival to a folder of its own, which is then moved
        to its place as a run. Rows of a null arrival, or of one out of range, come with the first.
        """
        name = _free("arrival", rows.columns)
        staged = f"staged/{uuid.uuid4().hex}"
        part = F.coalesce(F.when(arrival.between(0, arrivals - 1), arrival), F.lit(0)).cast("int")
        rows.withColumn(name, part).write.partitionBy(name).parquet(f"{self.path}/{staged}")
        fs, version = self._fs(), 0
        fs.mkdirs(self._at("data"))
        for i in range(arrivals):
            last, files = (self.versions() or [0])[-1], None
            if fs.exists(self._at(staged, f"{name}={i}")):
                run = self._new_run(last + 1)
                if not fs.rename(self._at(staged, f"{name}={i}"), self._at("data", run)):
                    raise OSError(f"arrival {i} can't be moved to its place")
                files = self._files(run)
            self._append(files, last)
            version = self.compact()
        fs.delete(self._at(staged), True)
        return version

    def compact(self) -> int:
        """Merges full tiers, smallest first, until none is full; returns the newest version."""
        while True:
            version = (self.versions() or [0])[-1]
            tiers: dict[int, list[tuple[str, int]]] = {}
            for run, tier, size in self.runs():
                tiers.setdefault(tier, []).append((run, size))
            full = sorted(t for t, runs in tiers.items() if len(runs) >= self.fan_in)
            if not full:
                return version
            merging = tiers[full[0]]
            rows = self.spark.read.parquet(*[f"{self.path}/data/{run}" for run, _ in merging])
            files = self._write(rows.coalesce(max(1, round(sum(s for _, s in merging) / self.target_bytes))), version + 1)
            rest = self.manifest(version).where(~F.col("run").isin([run for run, _ in merging]))
            # a merged run counts as above the tier it came from, even where it packs smaller
            files = files.withColumn("tier", F.greatest("tier", F.lit(full[0] + 1)))
            self._commit(rest.unionByName(files), version + 1)

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with columns run and file added; None if the version has no files.

        Stored columns keep their names: an added one whose name is taken gets underscores behind it
        until it is free.
        """
        runs = [run for run, _, _ in self.runs(version)]
        if not runs:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/data/{run}" for run in runs])
        return rows.withColumns({_free("run", rows.columns): F.regexp_extract("_metadata.file_path", _RUN, 1), _free("file", rows.columns): F.col("_metadata.file_name")})

    def vacuum(self, keep: int = 1, older_than: timedelta = timedelta(days=7)) -> int:
        """Deletes all versions but the newest ``keep``, and runs that these don't have; returns how many runs went.

        A run is on disk before its version is, so runs younger than ``older_than`` stay: they may be
        those of a writer at work.
        """
        fs, versions = self._fs(), self.versions()
        kept = {run for v in versions[-keep:] for run, _, _ in self.runs(v)}
        before, gone = (time.time() - older_than.total_seconds()) * 1000, 0
        for v in versions[:-keep]:
            fs.delete(self._at("manifest", f"v{v:08d}"), True)
        for x in fs.listStatus(self._at("data")):
            if x.getPath().getName() not in kept and x.getModificationTime() <= before:
                gone += fs.delete(x.getPath(), True)
        return gone


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def load_in_arrivals(store: ShardStore, df: DataFrame, key: str, arrivals: int) -> DataFrame:
    """Appends ``df`` to the store in ``arrivals`` ranges of a numeric key, compacting after each; the snapshot.

    Ranges come from the key's quantiles. Null keys come with the first arrival, rows of one key
    together; repeated rows and texts of any length are stored as they are. Every version stays
    readable until vacuum(). An empty table gives its own columns with run and file, without rows.
    """
    points = [i / arrivals for i in range(1, arrivals)]
    edges = sorted(set(df.agg(F.percentile_approx(F.col(key), points, 10_000).alias("q")).first().q or []))
    store.append_arrivals(df, F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(key))) if edges else F.lit(0), arrivals)
    out = store.snapshot()
    return out if out is not None else df.withColumns({_free(c, df.columns): F.lit("") for c in ("run", "file")})

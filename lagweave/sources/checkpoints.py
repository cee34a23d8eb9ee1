"""Results that survive a run: per-trajectory checkpoints with resume, and cached bootstrap edges by configuration."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which every executor sees.

    Where that is unset, a session of this machine alone takes a temporary folder; any other is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("lagweave.scratch.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lagweave-")
        spark.conf.set("lagweave.scratch.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: what several steps use is computed once, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append(results: DataFrame, path: str, config: dict) -> None:
    """Adds rows (trajectory_index, ...) of one configuration; a folder holds one configuration only."""
    known = _read(results.sparkSession, path)
    mark = signature(config)
    if known is not None and known.where(F.col("config") != mark).head(1):
        raise RuntimeError("the checkpoint was written with another configuration")
    results.withColumn("config", F.lit(mark)).write.mode("append").parquet(path)


def pending(trajectories: DataFrame, spark: SparkSession, path: str, retry_failed: bool = False) -> DataFrame:
    """The trajectories that have no result yet, or only a failure if those are retried."""
    known = _read(spark, path)
    if known is None:
        return trajectories
    if "failed" in known.columns and retry_failed:
        known = known.where("NOT coalesce(failed, false)")
    return trajectories.join(known.select("trajectory_index").distinct(), "trajectory_index", "left_anti")


def cached_edges(spark: SparkSession, folder: str, config: dict, make) -> DataFrame:
    """The edges stored for a configuration, made and stored first if there are none."""
    path = f"{folder}/{signature(config)}"
    if (known := _read(spark, path)) is None:
        make().write.mode("errorifexists").parquet(path)
        known = spark.read.parquet(path)
    return known


class RunCache:
    """Results of numbered runs in a folder, one configuration each: committed in waves, read back, cut or extended.

    A wave is a table of its own; a row of the manifest commits it, so that a wave that was broken off counts as absent. Runs
    are committed in order from 0, also those without any result.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{signature(config)}"

    def _waves(self) -> list:
        known = _read(self.spark, f"{self.folder}/manifest")
        waves = sorted((r["first"], r["last"], r["wave"]) for r in known.collect()) if known is not None else []
        kept, following = [], 0
        for first, last, wave in waves:  # of waves that two writers committed, the first by name counts
            if first == following:
                kept.append((first, last, wave))
                following = last + 1
        return kept

    def count(self) -> int:
        """How many runs are committed."""
        return max((last + 1 for _, last, _ in self._waves()), default=0)

    def commit(self, rows: DataFrame, first: int, last: int) -> None:
        """Stores the results of the runs first to last, which follow those that are there."""
        if first != self.count() or last < first:
            raise ValueError(f"runs {first} to {last} don't follow the {self.count()} that are stored")
        wave = f"{first:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{wave}")
        self.spark.createDataFrame([(first, last, wave)], "first int, last int, wave string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def read(self, runs: int) -> DataFrame:
        """The results of the first runs."""
        waves = [w for w in self._waves() if w[0] < runs]
        if not waves:
            raise ValueError("no run is stored")
        return self.spark.read.parquet(*[f"{self.folder}/{w[2]}" for w in waves]).where(F.col("run_id") < runs)

    def extend(self, make: Callable[[int, int], DataFrame], runs: int, wave: int = 0, seconds: float | None = None) -> int:
        """Makes the runs that are missing up to so many, in waves; returns how many of those there are.

        make(first, last) gives the results of these runs. When the time is up, no further wave begins; one run beyond run 0
        is made at least.
        """
        began = time.monotonic()
        while (have := self.count()) < runs:
            if have > 1 and seconds is not None and time.monotonic() - began >= seconds:
                break
            last = min(runs, have + wave if wave else runs) - 1
            self.commit(make(have, last), have, last)
        return min(self.count(), runs)


def fingerprint(rows: DataFrame) -> str:
    """A mark of a table's rows, whatever their order, for a configuration."""
    found = rows.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(rows.columns)}))").alias("h"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{found['n']}:{found['h']}:{found['s']}"


def preview(df: DataFrame, max_rows: int = 20) -> str:
    """The first rows as a scrollable HTML table."""
    return f'<div style="overflow:auto;max-height:480px">{df.limit(max_rows).toPandas().to_html(index=False)}</div>'

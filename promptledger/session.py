"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(app: str = "promptledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for. Pass `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A checkpoint goes when nothing refers to it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder in `spark.checkpoint.dir`.

    Only a local session that names none gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="promptledger-"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made in this block give their shuffle files back when their run ends, not when the driver next collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder, so lost executors re-read instead of recompute."""
    use_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def computed_once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """The kept columns and some costly ones that later filters must not repeat.

    Spark moves a filter below a projection by copying the projected expression into it, which would run
    detectors twice and blow up chains of them. A one-element generator gives the same rows, and filters
    on its columns stay above it; filters on the kept columns still reach the scan.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    done = df.select(*kept, *columns)
    new = [F.col(f"`{c}`") for c in done.columns[len(keep):]]
    return done.select(*kept, F.inline(F.array(F.struct(*new))))

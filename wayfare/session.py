"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "wayfare", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own conf."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; only when nothing is set
    (local tests) do we create a scratch folder of our own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="wayfare-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[SparkSession, list] = {}  # of each session: how many, and its setting before the first
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Writes that end inside take the files of their shuffles with them.
    Otherwise these stay until the driver happens to collect its garbage, and
    the shuffles of a job of many steps lie on disk all at once."""
    with _lock:
        held = _writers.setdefault(spark, [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writers[spark]
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that ``cut_lineage`` writes inside are deleted at the end;
    nothing that reads them may outlive it. Yields their paths."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once as a Parquet table in the shared checkpoint
    folder and read it back: later readers see exactly these rows (also
    after a lost executor), the plan above it starts from a scan, and the
    input is computed a single time (``Dataset.checkpoint`` would compute it
    twice without a cache). Never a local checkpoint."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root}/tables/{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    with no_shuffles_left(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def cut_through(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage`` of what ``build`` gives; the tables that it wrote on
    the way are deleted."""
    outer = _made.get()
    with scratch_tables(spark) as made:
        df = cut_lineage(build())
        path = made.pop()
    if outer is not None:
        outer.append(path)
    return df

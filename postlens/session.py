"""Session helpers: a builder with sane defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT = threading.local()  # frames persisted by this thread's query, by session


def build_session(app: str = "postlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` entries override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # a call site per Column is slow to build
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="postlens-")
    sc.setCheckpointDir(scratch)
    return scratch


def fresh_path(spark: SparkSession, name: str) -> str:
    """A not yet existing path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def on_disk(df: DataFrame, name: str) -> DataFrame:
    """Write a frame of costly columns to the shared folder once and read it back: smaller there than as a checkpoint."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_BYTES = 8 << 20  # of a batch that goes to a Python worker


def send_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import it.

    Batches to Python workers are held to ARROW_BYTES, so that long texts don't fill an executor.
    """
    sc = spark.sparkContext
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not limit.rstrip("b").isdigit() or int(limit.rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(sc, "_postlens_sent", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="postlens-code-")  # read by the driver's own file server only
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "postlens_code"), "zip", os.path.dirname(package), os.path.basename(package)))
    sc._postlens_sent = True


def spread(df: DataFrame, key: list[str] | None) -> DataFrame:
    """Give a scan of few row groups enough tasks for costly per-row work.

    A scan with at least one task per core is returned as it is, so large tables are never
    shuffled here; only a small one, packed in fewer row groups than cores, is hashed on its
    unique key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not key or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)


def reuse(df: DataFrame) -> DataFrame:
    """Persist a frame that one query reads several times (lineage is kept)."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _frames(df.sparkSession).append(kept)
    return kept


def _frames(spark: SparkSession) -> list[DataFrame]:
    by_session = _KEPT.__dict__.setdefault("frames", {})
    return by_session.setdefault(id(spark._jsparkSession), [])


def release(spark: SparkSession) -> None:
    """Drop what `reuse` persisted in this thread and session; a frame still in use is recomputed, not lost."""
    frames = _frames(spark)
    while frames:
        try:
            frames.pop().unpersist()
        except Exception:  # the context that owned the frame was stopped
            pass

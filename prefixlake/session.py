"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it runs from a checkout rather than an install.

    Only the search path of workers gains an entry; on machines without that folder it has no effect.
    Arrow batches are bounded by ``BATCH_BYTES`` instead of Spark's 64 MB, unless the session says
    otherwise: a batch of long texts is held several times over, on both sides of the pipe.
    """
    if spark.conf.get(_BYTES, "67108864b") == "67108864b":
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in path:
        env["PYTHONPATH"] = ":".join([*path, _ROOT])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see.

    In local mode a temporary one serves where none is set; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='prefixlake-')}")
        found = context.getCheckpointDir()
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; its lineage ends there."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED = "spark.matchform.shipped"

RUNTIME_SETTINGS = {
    # The JVM never compiles methods above 8000 bytes; let Spark generate smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Pages differ in length by orders of magnitude; bound a Python batch by size, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}

# Text goes to Python in batches of a few blocks: the JVM, the worker's buffer and its arrays each hold one of them.
TEXT_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

# Wide rows with many rolling columns take ten times their shuffled size in a sort: shuffles are dealt finely enough that
# adaptive execution can keep each task's part small whatever the input, and so are the files that are counted first.
TASK_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # Rows that lie together by a part of a join's key stay where they are; only the other side moves.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that may still be changed at run time."""
    for key, value in (RUNTIME_SETTINGS | TASK_SETTINGS).items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def with_settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Run-time settings for the jobs that run inside; what was set before is put back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def build_session(app: str = "matchform", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **RUNTIME_SETTINGS,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names; every executor must be able to reach it.

    Where the setting is missing, a session that is one process makes a folder of its own; any other stops.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    one_process = context.master == "local" or context.master.startswith("local[")
    if not configured and not one_process:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="matchform-checkpoint-"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed nor share a folder with the driver."""
    if spark.conf.get(SHIPPED, None):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(here.rglob("*.py")):
            archive.write(file, file.relative_to(here.parent))
    target = Path(spark.sparkContext._temp_dir) / f"{here.name}.zip"  # the driver serves it to the executors
    target.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(SHIPPED, "true")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that partition numbers survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """Write a table once, as Parquet in the shared checkpoint folder, and read it back: smaller than checkpointed rows."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so when the driver collects garbage.

    Python's objects let go of the JVM's with the next call, so it takes two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()

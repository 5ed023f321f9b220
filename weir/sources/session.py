"""Spark session and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weir.sources.paths import is_local


def get_session(app: str = "weir", master: str | None = None, checkpoint_dir: str | None = None, delta: bool = False, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on, which removes checkpoints that are no longer used.
    ``conf`` uses ``__`` for dots. ``checkpoint_dir`` is a folder that all machines share; ``delta`` sets
    the extension and catalog of that source, whose package must be on the class path."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if checkpoint_dir:
        defaults["spark.checkpoint.dir"] = checkpoint_dir
    if delta:
        defaults |= {"spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension", "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog"}
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package: from where the driver has it, whatever their working
    directory, and on a cluster from a copy that is sent along once per session."""
    context, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
    held = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in held:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, held)])
    if not is_local(spark):
        folder = Path(tempfile.mkdtemp(prefix="weir-package-"))  # the driver's own, served to executors
        shutil.copytree(Path(root) / "weir", folder / "copy" / "weir", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / "weir"), "zip", folder / "copy"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to.

    A cluster names it in ``spark.checkpoint.dir``; that setting always wins. Only where it is
    unset on a single machine (tests, a laptop) is a local folder made up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not is_local(spark):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weir-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

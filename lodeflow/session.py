"""Session factory and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodeflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and ANSI on. conf: further settings, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that their Python can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeflow_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodeflow-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lodeflow-package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("lodeflow", os.path.relpath(os.path.join(at, f), here)))
    sc.addPyFile(f"{folder}/lodeflow-package.zip")
    sc._lodeflow_shipped = True


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one all executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder, removed
    when Python ends; on a cluster a missing setting is an error, since a
    machine's own folder would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lodeflow_shared", None)
    if not root:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodeflow-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark._lodeflow_shared = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable, without replacing a folder the cluster names."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(root or shared_dir(spark, "checkpoint"))


def stored(df: DataFrame, purpose: str = "table") -> DataFrame:
    """df written as parquet to the shared folder and read back.

    Cuts the lineage like a checkpoint, survives lost executors, and what
    follows knows the table's size and reads only the columns it needs.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")

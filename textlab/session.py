"""Session helpers: a local session for tests/bench, and the shared scratch area.

Library code never reconfigures a session it is handed, with two exceptions:
when the session names no checkpoint directory (tests, local runs) a local one
is set so that ``checkpoint()`` works, and where it names no size of the batches
sent to Python workers, :func:`prepare` sets a small one. On a cluster
``spark.checkpoint.dir`` must name a shared folder, and it is used as is.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "textlab", driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


#: Bytes of a batch sent to a Python worker. The default (64 MB, or 10,000 rows) of long texts is held
#: several times over, outside the heap of the JVM and in the worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Make a session ready for this library's queries: workers import it, batches are small, checkpoints work."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    conf = spark._jsparkSession.sessionState().conf()
    if not conf.contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))


_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (like ``--py-files``).

    Functions run in Python workers (numpy block reductions, injected models)
    are pickled by reference, so the workers must be able to import
    ``textlab`` whatever the driver's working directory. Once per application.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="textlab-pkg-"), "textlab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - key absent
            named = None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textlab-ckpt-")  # one machine: tests, local runs
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/textlab-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that this driver wrote with :func:`scratch_path`.

    For the end of a job: frames that read them must not be used afterwards.
    """
    conf = spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)

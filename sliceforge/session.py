"""Session helpers: a local session for tests / bench, package shipping and
the checkpoint folder."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[int] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sliceforge") -> SparkSession:
    """A local session configured the way the library expects (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows are whole documents: keep Arrow batches to the packer small
        # (also bounded by spark.sql.execution.arrow.maxBytesPerBatch).
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SLICEFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and only read here (an
    unset folder is an error there).  Only in local mode, when it is unset
    (tests, local runs), a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # A machine-local folder would scatter the data over executors' disks.
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="sliceforge-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` once as parquet under ``spark.checkpoint.dir``
    (the cluster's shared folder) and return a DataFrame reading it back.

    Unlike an eager ``Dataset.checkpoint()`` without persistence, the plan is
    computed once (the checkpoint write would recompute it).  The tables of an
    application are in one folder, which is deleted when the driver ends: the
    results that are read from them are lazy until then.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder under ``spark.checkpoint.dir``; the
    folder is deleted when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sliceforge-{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_delete_folder, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_SCRATCH: set[str] = set()


def _delete_folder(spark: SparkSession, folder: str) -> None:
    """Best effort at the driver's end (a killed driver leaves the folder)."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as exc:  # the JVM may have gone first
        log.debug("scratch folder %s stays: %s", folder, exc)


def ship_package(spark: SparkSession) -> None:
    """Make ``sliceforge`` importable by Python workers (``--py-files`` equivalent).

    The pandas UDFs refer to module-level helpers; workers import them from this
    zip.  Done once per SparkContext.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    # Already shipped by the deployment (--py-files / spark.submit.pyFiles), or
    # explicitly disabled because executors have the package installed.
    if "sliceforge" in (sc.getConf().get("spark.submit.pyFiles", "") or "") or (
        spark.conf.get("spark.sliceforge.shipPackage", "true").lower() == "false"
    ):
        _SHIPPED.add(key)
        return
    out = os.path.join(tempfile.mkdtemp(prefix="sliceforge-pyfiles-"), "sliceforge.zip")
    root = os.path.dirname(_PKG_DIR)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, dirs, files in os.walk(_PKG_DIR):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)

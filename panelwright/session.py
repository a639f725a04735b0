"""Session construction and lineage cutting.

Settings that matter at scale are set here once: adaptive execution (runtime
coalescing, skew-join splitting, size-checked broadcast conversion), Arrow for
the few grouped-map jobs, and UTC so that no date arithmetic depends on the
host.  Explicit ``broadcast()`` is used only for tables whose size is bounded
by construction (literal dictionaries, one-row scalars); every other small
side is left to ``spark.sql.autoBroadcastJoinThreshold``, which AQE checks
against the runtime size of the shuffled side.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(master: str | None = None, app: str = "panelwright",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _own_folder(prefix: str) -> str:
    """A folder of this driver process, removed when it ends."""
    path = os.path.realpath(tempfile.mkdtemp(prefix=prefix))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session
    without one (tests) gets a private scratch folder, removed at exit."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = _own_folder("panelwright-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    return a DataFrame reading it back.

    This cuts lineage like ``checkpoint()`` (a lost executor re-reads the
    table instead of recomputing the fact joins behind it) and, unlike an RDD
    checkpoint, keeps file statistics, column pruning and filter pushdown for
    every later reader.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise a stage that several later stages read (see ``materialize``)."""
    return materialize(df, name)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``panelwright`` importable in Python workers (grouped-map jobs
    pickle references to its functions): zip the package once per
    SparkContext and ``addPyFile`` it, so executors get it from the driver."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(_own_folder("panelwright-py-"), "panelwright.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def spread_by_keys(df: DataFrame, keys) -> DataFrame:
    """Hash-partition by ``keys`` into 2 × the cluster's cores.

    Used before CPU-heavy per-series work (ETS folds, ARIMA fits): those
    inputs are small in bytes (one row or a few rows per series), so AQE
    would coalesce them into a single task; a fixed, core-sized partition
    count keeps the work spread over every executor.  Grouped operators keyed
    by the same columns reuse this partitioning (no second exchange).
    """
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, 2)
    return df.repartition(n, *keys)

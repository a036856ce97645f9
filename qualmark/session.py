"""Session helpers: a tuned builder for tests/bench and scratch locations.

Scratch data (round trips, streaming sinks, lineage cuts) lives under the
cluster-wide ``spark.checkpoint.dir``. A machine-local folder is only made
when that setting is unset *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _driver_memory(cap_gb: int = 8) -> str:
    """60% of physical memory, at most ``cap_gb`` (local mode: the driver is
    the only JVM)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return f"{cap_gb}g"
    mb = int(total * 0.6) >> 20
    return f"{max(1024, min(cap_gb << 10, mb))}m"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "qualmark") -> SparkSession:
    """Session with AQE on and the UI off; for tests and the bench."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", _driver_memory())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only in local mode.

    Works with a classic session (SparkContext) and with Spark Connect
    (configuration only)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return (sc.getCheckpointDir() if sc is not None else None) or current
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset; set it to a shared folder (e.g. on "
            "the cluster's distributed file system) before running qualmark jobs")
    local = tempfile.mkdtemp(prefix="qualmark-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir()
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "qualmark", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: lineage is cut (survives executor loss) and, unlike an RDD
    checkpoint, later reads prune columns and push filters down."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._scratch_path = path
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, as an archive;
    every stage with Python code of the package calls it. Local masters too: their
    workers import from the driver's working folder, not from its ``sys.path``."""
    sc = spark.sparkContext
    if not getattr(sc, "_qualmark_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="qualmark-ship-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "qualmark"), "zip", root, "qualmark"))
        sc._qualmark_shipped = True


#: Rows and bytes of a piece of an Arrow batch that Python works on at a time.
PIECE_ROWS = 512
PIECE_BYTES = 2 << 20


def arrow_pieces(batch, rows: int = PIECE_ROWS):
    """A record batch in order, in slices of at most ``rows`` rows and about
    ``PIECE_BYTES`` bytes (a single row may be larger). Nothing is copied."""
    step = max(1, min(rows, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


#: Most rows and bytes of an Arrow batch inside ``small_batches``.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends its rows to Python in batches of at most
    ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes. A batch is held by the JVM
    and by the worker, and by Spark's defaults it has 10,000 rows or 64 MB. Settings
    that ask for less stay; those changed come back at the end."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
             "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    jconf = spark._jsparkSession.sessionState().conf()
    now = dict(zip(names, (jconf.arrowMaxRecordsPerBatch(), jconf.arrowMaxBytesPerBatch())))
    old = {k: spark.conf.get(k) for k, most in names.items() if not 0 < now[k] <= most}
    try:
        for k in old:
            spark.conf.set(k, str(names[k]))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def discard(df) -> None:
    """Delete the table of a ``materialize``; nothing may read it any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least twice the task slots); AQE then coalesces small ones and
    splits skewed ones. Scan splits stay at 128 MB; Arrow batches for model
    calls are small because each row can be a long prompt."""
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.session.timeZone": "UTC",
    }

"""Spark session defaults and the shared checkpoint folder.

Every job in the library is DataFrame-in / DataFrame-out; this module only
builds a session with the settings the jobs assume (UTC, AQE with skew-join
splitting, Arrow) and resolves the folder used to cut long lineages.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes. AQE re-plans joins from runtime sizes (the size
# check behind every non-hinted broadcast), coalesces small shuffle
# partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "mercato", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``master='local[8]'``. ``shuffle_partitions`` should be sized so one
    shuffle partition stays around 128-256 MB at the target scale.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Read from the session. Only in local mode, when it is unset (tests), a
    fresh scratch folder is created; on a cluster an unset value is an error,
    because a driver-local folder is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder (HDFS / object store) "
                               "on a cluster")
        configured = tempfile.mkdtemp(prefix="mercato-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that tasks
    can import it wherever the driver was started."""
    sc = spark.sparkContext
    with _SHIPPING:  # fits are started from several threads; none goes on before the package is there
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="mercato-")) / "mercato.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted((root / "mercato").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(packed))
        _SHIPPED.add(sc.applicationId)


_SHIPPING = threading.Lock()
_SHIPPED: set[str] = set()
_STORED: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back. Later jobs read the files instead of repeating the plan, a
    lost executor costs nothing, several readers see the same rows in the
    same buckets, and the planner knows the table's size (so it broadcasts
    the table only if it is under ``autoBroadcastJoinThreshold``)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote in this application; call it
    when the results that read them have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _STORED.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def sized_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
               expansion: float = 1.0) -> dict:
    """Shuffle / scan sizing for a job reading ``input_bytes`` on a cluster
    with ``total_cores`` executor cores.

    Shuffle partitions are chosen so one post-shuffle partition holds about
    ``target_partition_bytes`` of (``expansion`` x input) data — at least two
    waves of tasks, rounded up to a multiple of the core count — and AQE
    coalesces towards the same size. Scan splits are capped at the same size
    so a task never reads more than it can hold.
    E.g. 100 TB on 1000 executors x 8 cores: ~409,600 shuffle partitions of
    ~256 MB."""
    cores = max(1, int(total_cores))
    by_size = int((input_bytes * expansion) // target_partition_bytes) + 1
    n = max(2 * cores, by_size)
    n = ((n + cores - 1) // cores) * cores
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }

"""Session helpers: the settings the engine relies on and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that results depend on. Everything else is left to the cluster.
SEMANTIC_CONF = {"spark.sql.session.timeZone": "UTC"}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidebar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


#: What the bar engine needs besides: a division by zero is NULL, as a missing value is.
BAR_CONF = {"spark.sql.ansi.enabled": "false"}


def ensure_semantics(spark: SparkSession, bars: bool = False) -> None:
    for key, value in {**SEMANTIC_CONF, **(BAR_CONF if bars else {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names it, else one made for this machine alone."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = "file://" + tempfile.mkdtemp(prefix="tidebar-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def ensure_checkpoint(spark: SparkSession) -> str:
    """Makes checkpoint() usable and returns the shared folder."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Scratch paths that this process has given out and not removed.
_MADE: list[str] = []


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder. What operators write there stays readable, as their results are lazy, until release() is called."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> int:
    """How many scratch paths there are; release() can go back to this point."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Removes the scratch paths given out since a point, but for those to keep. Results that read them can't be computed again afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _MADE[since:] if p not in keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _MADE.remove(path)

"""Session helpers: settings, the shared folder, and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "panelcast", cores: str = "*") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="panelcast-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep it as a reliable checkpoint.

    The copy lives in the shared folder, so a lost executor does not lose it and
    nothing before it runs again. What this step and earlier ones left on disk goes.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = df.checkpoint(eager=True)
    del df  # or this step's own shuffle files would lie until the next one has run
    release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner waits for the driver's garbage collection, which comes late in jobs of
    many short steps: until then the files of all steps lie on disk together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int) -> None:
    """Rows that go to Python at once in this session: ``rows``, or fewer if that is set.

    A batch of long texts takes memory in the JVM and in Python at the same time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if not 0 < given <= rows:
        spark.conf.set(name, str(rows))


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote and needs no more."""
    system, place = _file_system(spark, path)
    system.delete(place, True)

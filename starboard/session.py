"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "starboard",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Session with UTC, ANSI SQL and adaptive execution.

    AQE merges small shuffle partitions and splits skewed ones, so on a cluster
    ``shuffle_partitions`` is an upper figure: about the largest shuffle's bytes / 128 MB.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def filtering_session(spark: SparkSession, large_from: str = "1GB", broadcast_up_to: str | None = None) -> SparkSession:
    """A session beside this one whose joins filter a large side by the keys of a selective one, before it is shuffled.

    Spark puts a Bloom filter of the small side's keys into the scan of the large one if the latter has ``large_from`` bytes
    or more, the small side is cut by a condition and both are to be shuffled. The tables must be read in this session.
    """
    session = spark.newSession()
    prefix = "spark.sql.optimizer.runtime.bloomFilter"
    session.conf.set(f"{prefix}.enabled", "true")
    session.conf.set(f"{prefix}.applicationSideScanSizeThreshold", large_from)
    if broadcast_up_to is not None:
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_up_to)
        session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", broadcast_up_to)
    return session


_made: dict[str, list[str]] = {}
_prepared: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, it is the place of the session's own tables; that is an error if only this machine can reach it
    and the executors are on others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    if "://" in folder and not folder.startswith("file:"):
        return folder
    path, files = hadoop_path(spark, folder)
    if files.makeQualified(path).toUri().getScheme() == "file" and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors reach; {folder} is on the driver")
    return folder


def hadoop_path(spark: SparkSession, name: str):
    """Path and file system of a name, as Spark's readers see it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the files in a folder."""
    path, files = hadoop_path(spark, source)
    found, listed = [], files.listFiles(path, True) if files.exists(path) else None
    while listed is not None and listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. ``clear_work`` deletes it."""
    path = f"{shared_folder(spark)}/starboard/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps do not repeat what made them."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """A folder that ``write`` fills once for each session and source, for all who ask for it.

    A source whose files have other names, sizes or times than before is another one.
    """
    key = (spark.sparkContext.applicationId, name, source, _files(spark, source))
    if key not in _prepared:
        folder = new_folder(spark, name)
        write(folder)
        _prepared[key] = folder
    return _prepared[key]


def clear_work(spark: SparkSession) -> None:
    """Drop the databases and delete the folders that this session made here; results read from them end with it."""
    application = spark.sparkContext.applicationId
    folders = _made.pop(application, [])
    for database in spark.catalog.listDatabases():
        if any((database.locationUri or "").endswith(f.split("://", 1)[-1].split(":", 1)[-1]) for f in folders):
            spark.sql(f"DROP DATABASE IF EXISTS {database.name} CASCADE")
    for table in spark.catalog.listTables():
        if not table.isTemporary and table.tableType == "EXTERNAL":
            where = spark.sql(f"DESCRIBE TABLE EXTENDED {table.name}").where("col_name = 'Location'").first()
            if where and any(f.split(":", 1)[-1].lstrip("/") in where["data_type"] for f in folders):
                spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    files = spark._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = files.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    for key in [k for k in _prepared if k[0] == application]:
        del _prepared[key]


def let_go(spark: SparkSession) -> None:
    """Shuffle files and blocks that nothing refers to any more go now, not when the driver next happens to collect its garbage.

    Spark itself refers to what it shuffled last until something else ran, so a small query runs before, and all is done twice.
    """
    for _ in range(2):
        spark.range(5).count()
        gc.collect()
        spark._jvm.System.gc()


def delete_folder(spark: SparkSession, name: str) -> None:
    path, files = hadoop_path(spark, name)
    files.delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give ``checkpoint()`` and ALS a folder when the session has none yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))

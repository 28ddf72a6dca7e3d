"""Session helper and the one place where intermediate tables are written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as text, of a join side that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Setting that removes the shuffle files of a written table at the end of the write.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written inside the open ``scope`` blocks, innermost last.
_SCOPES: list[list[str]] = []


def session(app: str = "perfspark", **conf: str) -> SparkSession:
    """A session with the settings the library relies on (AQE, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Without that setting it
    is a folder of the warehouse, unless that is on the driver's own disk and
    the executors are on other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = root.partition(":")[0] if ":" in root else "file"
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return root + "/_intermediate"


def _app_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/perfspark/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own, deleted with the intermediate tables."""
    path = f"{_app_folder(spark)}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later passes see fixed rows and
    read only the columns they need, and a lost executor costs no re-run."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _without_shuffles(spark: SparkSession):
    """Writes inside the block leave no shuffle files, which otherwise stay
    until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize_each(parts: Iterable[DataFrame]) -> DataFrame:
    """``materialize`` for the rows of several frames of one schema, written one
    after the other: the shuffle files of one are gone before the next."""
    path = None
    for df in parts:
        spark, path = df.sparkSession, path or new_folder(df.sparkSession)
        with _without_shuffles(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_last(make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` for what ``make`` returns; intermediate tables and shuffle
    files made on the way are deleted."""
    opened: list[str] = []
    _SCOPES.append(opened)
    try:
        df = make()
    finally:
        _SCOPES.pop()
        if _SCOPES:  # which also deletes what a failure leaves
            _SCOPES[-1].extend(opened)
    spark = df.sparkSession
    path = new_folder(spark)
    with _without_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    for p in opened:
        _delete(spark, p)
    return spark.read.schema(df.schema).parquet(path)


def shuffled_once(df: DataFrame) -> DataFrame:
    """``df`` as a table of its partitions: plans made of it share the shuffle
    files of ``df`` and do not shuffle again."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    _delete(spark, _app_folder(spark))


@contextmanager
def scope(spark: SparkSession):
    """Intermediate tables made inside the block are deleted at its end; write
    or collect what is wanted from them before."""
    opened: list[str] = []
    _SCOPES.append(opened)
    try:
        yield
    finally:
        _SCOPES.remove(opened)
        for path in opened:
            _delete(spark, path)


def lookup(df: DataFrame, max_rows: int = 200_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A derived join side (one row per key): written once, then broadcast if
    its size allows it.  Without this the large side would be shuffled before
    the small one is known to be small."""
    return small_side(materialize(df), max_rows, max_bytes)


def small_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows of at
    most ``max_bytes`` together, else unmarked, so that the join falls back to a
    shuffle.  The check reads no more than ``max_rows + 1`` rows."""
    text = F.to_json(F.struct("*"))
    some = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    few = some["rows"] <= max_rows and (some["bytes"] or 0) <= max_bytes
    return F.broadcast(df) if few else df

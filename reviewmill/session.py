"""Session defaults and the shared folder for intermediate tables."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("reviewmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, where every executor can read.

    Without the setting a local session gets a temporary folder; on a cluster a
    machine-local folder would be lost with the machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="reviewmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_OWNED: ContextVar[list[str] | None] = ContextVar("reviewmill_tables", default=None)


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/reviewmill/{name}-{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    return path


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables that are written inside the `with` block, and delete them
    at its end. What the block computes has to be written or collected before; until then
    every table stays, so lost tasks are run again from it. Scopes may be nested.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in owned:
            folder = hadoop(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_LOCK, _WRITERS, CLEANUP = threading.Lock(), [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run inside drop their shuffle files at their end, not when the
    driver's collector comes to them. The last of several threads puts the setting back."""
    with _LOCK:
        _WRITERS.append(spark.conf.get(CLEANUP, "false") if not _WRITERS else _WRITERS[0])
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _WRITERS.pop()
            if not _WRITERS:
                spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It is computed once, survives lost executors, and its size is known to the
    planner. `schema` may give a user type to columns written in its storage form.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with _shuffles_dropped(spark):  # select: the plan takes the setting where it is made
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


#: Rows of whole texts that go to Python at a time.
TEXT_ROWS = 256


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Whole texts go to Python so many rows at a time, in plans that run inside the block.
    The default of 10,000 rows is held several times over, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)

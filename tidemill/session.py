"""Session settings and the shared scratch folder.

Intermediate results that must be read more than once are written as parquet below the folder
the cluster names in ``spark.checkpoint.dir``. A written table survives the loss of an executor,
needs no recomputation, and keeps column pruning, which an RDD checkpoint would lose.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import inheritable_thread_target

from tidemill.sources.paths import filesystem

# Runtime settings the results or the skew handling depend on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs the aggregation above it one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_CHECKPOINT_DIR = "spark.checkpoint.dir"
# Folders made for local sessions that name none, by application.
_local_roots: dict[str, str] = {}


def build_session(app_name: str = "tidemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` use ``__`` for dots (``spark__ui__enabled``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and give its workers this package."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_tidemill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Spark's own folder on the driver, from which it serves files to the others and which it removes at the end.
    archive = os.path.join(SparkFiles.getRootDirectory(), "shipped", "tidemill-package")
    archive = shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._tidemill_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local-mode session without the setting gets a temporary folder of its own: on a
    cluster a machine-local folder is not visible to the other executors.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidemill-")
    return _local_roots[app]


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the scratch root."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{scratch_root(spark)}/tidemill/{app}/{label}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that still read them stop working.

    Databases placed below the scratch folder go with it, so this is the last step of a run.
    """
    app = spark.conf.get("spark.app.id", "app")
    files, folder = filesystem(f"{scratch_root(spark)}/tidemill/{app}")
    if files.get_file_info(folder).type == FileType.Directory:
        files.delete_dir(folder)


def stage(df: DataFrame, label: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the scratch folder and return it read back.

    ``folders`` are columns that get a folder per value, which filters on them then skip.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    schema = df.schema
    df.write.partitionBy(*folders).parquet(path)
    # The schema is known, so reading back needs no inference job.
    staged = spark.read.schema(schema).parquet(path)
    staged._tidemill_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for this frame; neither it nor frames that read it may be used any more."""
    context = staged.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(staged._tidemill_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def child_session(spark: SparkSession) -> SparkSession:
    """A session on the same catalog with its own temp views and settings."""
    child = spark.newSession()
    for key in (*RUNTIME_SETTINGS, "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            child.conf.set(key, value)
    return child


def side_by_side(spark: SparkSession, step: Callable[..., Any], arguments: Iterable[tuple], at_once: int = 4) -> list:
    """Run a step for several tables with their jobs overlapping; results in the given order.

    A job's last tasks leave most of a cluster idle; the next table's job fills it.
    """
    with ThreadPoolExecutor(at_once) as pool:
        # The wrapper hands the caller's job properties to the thread.
        running = [pool.submit(inheritable_thread_target(spark)(step), *args) for args in arguments]
        return [r.result() for r in running]


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A few rows of metadata as a DataFrame of known size, so that the planner may broadcast it."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = zip(*rows) if rows else [[] for _ in struct.names]
    arrow = to_arrow_schema(struct)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)

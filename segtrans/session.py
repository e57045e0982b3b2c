"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

# Settings the jobs of this package are tuned for. Speculation stays off: a
# second copy of a task would send the same texts to the backend again.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.speculation": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Of tables that are written to be read again: a third less disk than the default.
PACKED = "zstd"

_LOCAL_ROOTS: dict[str, str] = {}


def get_session(app: str = "segtrans", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Folder every executor can read and write, as named by the cluster.

    Only a local session may fall back on a temporary folder of its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="segtrans-")
    return _LOCAL_ROOTS[app]


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A path of its own for one run; the folder is made by the first write."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def run_id() -> str:
    return uuid.uuid4().hex[:12]


def ship_by_value(module) -> None:
    """Send the classes of ``module`` to Python workers inside the task itself.

    Saves installing the package on every node; ``--py-files`` works as well.
    """
    cloudpickle.register_pickle_by_value(module)


def with_int(schema: StructType, name: str) -> StructType:
    """The schema with one more integer column, as a new object."""
    return StructType([*schema.fields, StructField(name, IntegerType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path is on."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)



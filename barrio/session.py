"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "barrio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Run the body under other session settings and put the former ones back."""
    former = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in former.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in `spark.checkpoint.dir`. Where that is unset, a session whose executors all live in
    the driver's process gets a temporary folder, once per application and removed at its end; any
    other session is refused, as its executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[application], ignore_errors=True)
        folder = _OWN_FOLDERS[application]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a costly result feeds several consumers. The files outlive lost executors,
    unlike cached blocks, and give the optimiser true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of a shuffle.

    For costly work on rows of a scan: a file of few bytes or few row groups is read by one task, however many rows it holds.
    """
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The columns leave through a generator, so that no later filter is worked out before the rows are dealt.
    return dealt.select(F.inline(F.array(F.struct(*df.columns))))


def exists(spark: SparkSession, path: str) -> bool:
    """A finished table lies at the path."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)

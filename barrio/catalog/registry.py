"""Registration of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrio.fixtures import ORACLE_PARTS, oracle_text, projection, table
from barrio.plans.snapshot import STORE_COLUMNS, as_stores
from barrio.session import exists, new_path, settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The input tables of one query run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Zone-less test timestamps are read as UTC, as in the oracle.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name == "stores":
            return stored_places(self.spark, self.folder)
        if name.startswith("fx_"):
            return projection(self.spark, self.folder, name)
        return table(self.spark, self.folder, name)


def stores_table(places: DataFrame) -> DataFrame:
    """The stores table from its flat projection."""
    badges = F.filter(F.split("badge_list", ","), lambda b: b != "")
    return as_stores(places.withColumn("badges", badges))


_STORED: dict[tuple[str, str], str] = {}


def stored_places(spark: SparkSession, folder: str) -> DataFrame:
    """The stores snapshot of a test folder, in the engine's own layout.

    Queries over stores read a Parquet table partitioned by source, as jobs on a published
    snapshot do. It is derived from the test tables once per application.
    """
    key = (spark.sparkContext.applicationId, folder)
    columns = [c for c in STORE_COLUMNS if c != "source_name"] + ["source_name"]
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = new_path(spark, "stores")
        rows = stores_table(projection(spark, folder, "fx_places")).select(*columns)
        # A set number of parts: the adaptive planner would merge them into few large files.
        parts = spark.sparkContext.defaultParallelism
        # Its two tables both grow, so none is sent around, however small its file looks.
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            rows.repartition(parts, F.col("id")).write.partitionBy("source_name").parquet(path)
        _STORED[key] = path
    schema = ", ".join(f"{c} {STORE_COLUMNS[c]}" for c in columns)
    return spark.read.schema(schema).parquet(_STORED[key])


def query(name: str, oracle: str | None = None):
    """Register a query; the function gets a `Data`."""

    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            _SQL[name] = oracle
        return fn

    return register


def part(name: str, sql: str) -> None:
    """A reusable piece of oracle text, referred to as @name."""
    ORACLE_PARTS[name] = sql


def load() -> None:
    """Import every catalogue module and render the oracle texts."""
    from barrio.catalog import (  # noqa: F401
        audits, classes, hours, matching, scalars, serving, snapshots, sources, traffic,
    )

    for name, sql in _SQL.items():
        ORACLES[name] = oracle_text(sql)

"""Ledger, history, archive and snapshot publishing on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrio.operators.keyed import large_join

TABLES = ["import_runs", "stores", "store_activities"]


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append to a Parquet table."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def latest_runs(events: DataFrame) -> DataFrame:
    """Current state per run from its event rows: the last event wins.

    Each run's events reduce to one row on the map side.
    """
    facts = [c for c in events.columns if c != "run_id"]
    return events.groupBy("run_id").agg(
        F.max(F.struct("at", *[c for c in facts if c != "at"])).alias("e")
    ).select("run_id", "e.*")


def start_event(run_id: Column, source: Column, file_hash: Column, at: Column) -> list[Column]:
    """Columns of a run's opening event."""
    return _event(run_id, source, file_hash, at, "running")


def _event(run_id: Column, source: Column, file_hash: Column, at: Column, status: str | Column,
           rows: Column | None = None, inserted: Column | None = None, updated: Column | None = None,
           deactivated: Column | None = None, error: Column | None = None) -> list[Column]:
    state = F.lit(status) if isinstance(status, str) else status
    count = lambda c: F.lit(None).cast("bigint") if c is None else c.cast("bigint")
    return [
        run_id.alias("run_id"), at.alias("at"), source.alias("source_name"), state.alias("status"),
        file_hash.alias("file_hash"), count(rows).alias("row_count"), count(inserted).alias("inserted_count"),
        count(updated).alias("updated_count"), count(deactivated).alias("deactivated_count"),
        (F.lit(None).cast("string") if error is None else error).alias("error_message"),
    ]


def finish_event(run_id: Column, source: Column, file_hash: Column, at: Column, status: Column,
                 **counts: Column) -> list[Column]:
    """Columns of a run's closing event: succeeded with counts, or failed with an error."""
    return _event(run_id, source, file_hash, at, status, **counts)


def orphan_counts(stores: DataFrame, runs: DataFrame, acts: DataFrame) -> DataFrame:
    """Stores whose run is unknown and activities whose store is unknown, as one row.

    The referring side is counted per key first, so a run behind a third of all stores is a
    single row in the join.
    """
    by_run = (
        stores.where("last_import_run_id is not null").groupBy("last_import_run_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lost_stores = large_join(
        by_run, runs.select(F.col("id").alias("last_import_run_id")), "last_import_run_id", "left_anti"
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit("stores_without_run").alias("check"))
    by_store = acts.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    lost_acts = large_join(
        by_store, stores.select(F.col("id").alias("store_id")), "store_id", "left_anti"
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit("activities_without_store").alias("check"))
    return lost_stores.unionByName(lost_acts).select("check", "n")


def publish_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> DataFrame:
    """Write a snapshot version, check it, and point readers at it only if it is sound.

    Earlier versions stay untouched. Returns the pointer row: version, valid and table counts.
    """
    spark = tables["stores"].sparkSession
    for name in TABLES:
        frame = tables[name]
        writer = frame.write.mode("errorifexists")
        if name == "stores":
            writer = writer.partitionBy("source_name")
        writer.parquet(f"{root}/v{version}/{name}")
    written = {name: spark.read.parquet(f"{root}/v{version}/{name}") for name in TABLES}
    orphans = orphan_counts(written["stores"], written["import_runs"], written["store_activities"])
    counts = [
        written[name].agg(F.count(F.lit(1)).alias("n"), F.lit(name).alias("check")).select("check", "n")
        for name in TABLES
    ]
    facts = orphans
    for one in counts:
        facts = facts.unionByName(one)
    of = lambda name: F.max(F.when(F.col("check") == name, F.col("n")))
    pointer = facts.agg(
        F.lit(version).cast("bigint").alias("version"),
        (of("stores_without_run") + of("activities_without_store") == 0).alias("valid"),
        *[of(name).alias(name) for name in TABLES],
    )
    append_rows(pointer, f"{root}/pointer")
    return spark.read.parquet(f"{root}/pointer").where(F.col("version") == version)


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the latest valid version."""
    latest = spark.read.parquet(f"{root}/pointer").where("valid").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{latest}/{name}")


def refresh_row(started: Column, ended: Column, status: Column, pushed: Column, stores: DataFrame) -> DataFrame:
    """One history row of a refresh: times, minutes, status and served counts."""
    shown = F.col("is_published") & (F.col("confidence_level") != "excluded")
    hours = F.col("opening_hours_osm").isNotNull() | F.col("opening_hours_web").isNotNull()
    minutes = (F.unix_seconds(ended.cast("timestamp")) - F.unix_seconds(started.cast("timestamp"))) / 60
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return stores.agg(
        stamp(F.min(started)).alias("started_at"), stamp(F.min(ended)).alias("ended_at"),
        F.round(F.min(minutes), 1).alias("duration_min"),
        F.regexp_replace(F.min(status), "[,\r\n]", ";").alias("status"), F.min(pushed).alias("pushed"),
        F.count_if(shown).alias("active_stores"), F.count_if(shown & hours).alias("stores_with_hours"),
    )

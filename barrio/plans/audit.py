"""Data-quality queries over stores and runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrio.operators.match import METHODS
from barrio.plans.snapshot import EVIDENCE

ACTIVE = "confidence_level <> 'excluded'"
STALE_DAYS = {"osm": 30, "censo": 7}


def serving_counts(stores: DataFrame) -> DataFrame:
    """Physical, active, excluded rows and active rows with real hours."""
    active = F.col("confidence_level") != "excluded"
    hours = F.col("opening_hours_osm").isNotNull() | F.col("opening_hours_web").isNotNull()
    return stores.agg(
        F.count(F.lit(1)).alias("physical"), F.count_if(active).alias("active"),
        F.count_if(~active).alias("excluded"), F.count_if(active & hours).alias("real_hours"),
    )


def existence_proxy(stores: DataFrame) -> DataFrame:
    """Active rows per corroboration as told by badges."""
    osm = F.col("source_name") == "osm"
    proxy = (
        F.when(osm & F.array_contains("badges", "oficial"), "verified").when(osm, "mapped").otherwise("unverified")
    )
    return stores.where(ACTIVE).groupBy(proxy.alias("verification")).agg(F.count(F.lit(1)).alias("n"))


def missing_essentials(stores: DataFrame) -> DataFrame:
    """Active rows, blank names and missing addresses per source."""
    active = F.col("confidence_level") != "excluded"
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    return stores.groupBy("source_name").agg(
        F.count_if(active).alias("active"), F.count_if(active & blank).alias("blank_name"),
        F.count_if(active & F.col("address").isNull()).alias("no_address"),
    )


def exact_duplicates(stores: DataFrame) -> DataFrame:
    """Active rows sharing name and point, one row per member with the group's size.

    Groups are counted, never gathered: a group of any size stays spread over tasks.
    """
    key = ["normalized_name", "lat", "lng"]
    rows = stores.where(ACTIVE).where("normalized_name <> ''").select("id", *key)
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, key)


#: Ids in a block of a run ledger: no task orders more runs of a source than this.
BLOCK_IDS = 65_536


def reprocessed_runs(runs: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Runs flagged when the source's previous run had the same file hash.

    A source's ledger may be long, so it is cut into blocks of `block_ids` ids. Inside a block the previous run is a
    plain lag; the first run of a block looks at the last run of the nearest earlier block, found among one summary row
    per block. Ids may lie anywhere in the range of a long, and no bounds are read beforehand.
    """
    cut = runs.withColumn("_block", F.floor(F.col("id") / F.lit(block_ids).cast("decimal(20,0)")).cast("bigint"))
    last = cut.groupBy("source_name", "_block").agg(F.max_by("file_hash", "id").alias("_last"))
    earlier = last.select(
        "source_name", "_block",
        F.lag("_last").over(Window.partitionBy("source_name").orderBy("_block")).alias("_carried"),
    )
    inside = Window.partitionBy("source_name", "_block").orderBy("id")
    lagged = cut.select("*", F.lag("id").over(inside).alias("_before"), F.lag("file_hash").over(inside).alias("_hash"))
    joined = lagged.join(earlier, ["source_name", "_block"])
    previous = F.when(F.col("_before").isNull(), F.col("_carried")).otherwise(F.col("_hash"))
    flagged = joined.withColumn("reprocessed", F.coalesce(previous == F.col("file_hash"), F.lit(False)))
    return flagged.drop("_block", "_carried", "_before", "_hash")


def distribution(stores: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts per value of each column, as (field, value, n), in a single pass."""
    long = stores.select(F.expr("stack({}, {}) as (field, value)".format(
        len(columns), ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    )))
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def hours_coverage(stores: DataFrame) -> DataFrame:
    """Rows with mapped hours per source, in percent to one decimal."""
    return stores.groupBy("source_name").agg(
        F.count("opening_hours_osm").alias("with_hours"), F.count(F.lit(1)).alias("total")
    ).withColumn("pct", F.round(F.lit(100.0) * F.col("with_hours") / F.col("total"), 1))


def evidence_violations(stores: DataFrame) -> DataFrame:
    """Rows that break the evidence constraint, one row per breach: (check, id)."""
    empty = reduce(and_, [F.col(c).isNull() for c in EVIDENCE])
    sound = (
        (F.col("source_name") == "osm")
        & F.col("matched_censo_source").startswith("censo_")
        & F.col("matched_censo_local_id").isNotNull()
        & F.col("censo_match_version").isNotNull()
        & F.col("censo_match_method").isin(METHODS)
        & F.col("censo_match_distance_m").between(0, 30)
        & F.col("censo_match_name_similarity").between(0, 1)
    )
    broken = stores.where(~(empty | F.coalesce(sound, F.lit(False)))).select(
        F.lit("evidence_fields").alias("check"), F.col("id").cast("string").alias("key")
    )
    return broken.unionByName(
        _repeated(stores, ["source_name", "source_local_id"], "source_key")
    ).unionByName(
        _repeated(
            stores.where("matched_censo_source is not null"),
            ["matched_censo_source", "matched_censo_local_id"], "one_place_per_register_row",
        )
    )


def _repeated(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return repeated.select(F.lit(check).alias("check"), F.concat_ws("|", *keys).alias("key"))


def badge_consistency(stores: DataFrame) -> DataFrame:
    """Badges without evidence and evidence without badge."""
    badge, evidence = F.array_contains("badges", "oficial"), F.col("matched_censo_source").isNotNull()
    return stores.where("source_name = 'osm'").agg(
        F.count_if(badge & ~evidence).alias("badge_without_evidence"),
        F.count_if(evidence & ~badge).alias("evidence_without_badge"),
    )


def run_durations(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last runs with their duration in seconds."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return runs.withColumn("duration_s", seconds).orderBy(F.desc("id")).limit(n)


def spot_check(stores: DataFrame, source: str, lat: float, lng: float, n: int = 10) -> DataFrame:
    """The active rows of a source nearest to a point, in planar degrees."""
    d = F.pow(F.col("lat") - F.lit(lat), F.lit(2.0)) + F.pow(F.col("lng") - F.lit(lng), F.lit(2.0))
    return stores.where(ACTIVE).where(F.col("source_name") == source).orderBy(d, "id").limit(n)


def stale_sources(runs: DataFrame, now: Column) -> DataFrame:
    """Latest success per source and whether it is too old."""
    allowed = F.when(F.col("source_name") == "osm", STALE_DAYS["osm"]).otherwise(STALE_DAYS["censo"])
    latest = runs.groupBy("source_name").agg(
        F.max(F.when(F.col("status") == "succeeded", F.col("started_at"))).alias("last_success")
    )
    age = F.timestamp_diff("DAY", F.col("last_success"), now)
    return latest.withColumn("stale", F.coalesce(age > allowed, F.lit(True)))

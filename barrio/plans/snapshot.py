"""Snapshot changes: previous stores and a batch give the next stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.classify import SCORING_OSM
from barrio.operators.keyed import large_join
from barrio.operators.match import CLOSED_STATUS

MAX_PRUNE_FRACTION = 0.15
FIXTURE_SOURCE = "madrid_sample_fixture"

STORE_COLUMNS = {
    "id": "bigint", "source_name": "string", "source_local_id": "string", "name": "string",
    "normalized_name": "string", "address": "string", "postal_code": "string", "district": "string",
    "neighbourhood": "string", "lat": "double", "lng": "double", "place_type": "string",
    "sells_onsite_beer": "boolean", "sells_takeaway_beer": "boolean", "opening_hours_osm": "string",
    "opening_hours_web": "string", "hours_web_checked_at": "timestamp_ntz", "website": "string",
    "badges": "array<string>", "confidence_score": "int", "confidence_level": "string",
    "scoring_version": "string", "is_chain": "boolean", "official_status": "string",
    "last_seen_in_official_source_at": "timestamp_ntz", "last_seen_osm_at": "timestamp_ntz",
    "last_import_run_id": "bigint", "is_published": "boolean", "publication_reason": "string",
    "matched_censo_source": "string", "matched_censo_local_id": "string", "censo_match_version": "string",
    "censo_match_method": "string", "censo_match_distance_m": "double",
    "censo_match_name_similarity": "double", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
}

EVIDENCE = [
    "matched_censo_source", "matched_censo_local_id", "censo_match_version", "censo_match_method",
    "censo_match_distance_m", "censo_match_name_similarity",
]

_IDENTITY = ["name", "normalized_name", "address", "lat", "lng", "place_type", "sells_onsite_beer",
             "sells_takeaway_beer", "confidence_score", "confidence_level", "is_chain"]
_CENSUS = [*_IDENTITY, "district", "badges", "scoring_version"]

# Columns a batch overwrites on rows that exist already.
OVERWRITTEN = {
    "censo_barcelona": [*_CENSUS, "neighbourhood"],
    "censo_diba": _CENSUS,
    "censo_andalucia": _CENSUS,
    "censo_madrid": [*_CENSUS, "neighbourhood", "postal_code", "official_status"],
    FIXTURE_SOURCE: [*_CENSUS, "neighbourhood", "postal_code", "official_status"],
    "osm": [*_IDENTITY, "opening_hours_osm", "website"],
}
_OSM_CLEARED = ["district", "neighbourhood", "official_status", "last_seen_in_official_source_at"]


def as_stores(df: DataFrame) -> DataFrame:
    """All stores columns in order; absent ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in STORE_COLUMNS.items()
        ]
    )


def _on_seen(source: str, run_id: Column, now: Column) -> dict[str, Column]:
    """Values every row of the batch takes, new or known."""
    common = {"last_import_run_id": run_id, "updated_at": now}
    if source != "osm":
        return {**common, "last_seen_in_official_source_at": now}
    cleared = {c: F.lit(None) for c in _OSM_CLEARED}
    return {
        **common, **cleared, "last_seen_osm_at": now, "is_published": F.lit(True),
        "publication_reason": F.lit(None),
    }


def _on_insert(source: str, now: Column) -> dict[str, Column]:
    """Defaults of a new row beyond the batch's own columns."""
    first = {
        "id": F.xxhash64(F.lit(source), F.col("source_local_id")), "source_name": F.lit(source),
        "created_at": now,
    }
    if source == "osm":
        return {**first, "badges": F.array().cast("array<string>"), "scoring_version": F.lit(SCORING_OSM)}
    return {**first, "is_published": F.lit(False), "publication_reason": F.lit("censo_only_unconfirmed")}


def merge_source(stores: DataFrame, batch: DataFrame, source: str, run_id: Column, now: Column) -> DataFrame:
    """The source's rows after an upsert, with `change`: inserted, updated or untouched.

    Keys are unique on both sides. Only the source's own partition is read and joined.
    """
    own = stores.where(F.col("source_name") == source)
    fresh = batch.select(
        "source_local_id", F.struct(*[c for c in batch.columns if c in STORE_COLUMNS]).alias("_b")
    )
    held = own.select("source_local_id", F.struct(*[c for c in own.columns]).alias("_p"))
    joined = held.join(fresh, "source_local_id", "full")
    in_batch, known = F.col("_b").isNotNull(), F.col("_p").isNotNull()
    seen, insert = _on_seen(source, run_id, now), _on_insert(source, now)
    overwritten, given = set(OVERWRITTEN[source]), set(batch.columns)

    def value(column: str, kind: str) -> Column:
        old = F.col(f"_p.{column}") if column in own.columns else F.lit(None)
        new = F.col(f"_b.{column}") if column in given else F.lit(None)
        on_update = seen.get(column, new if column in overwritten else old)
        on_new = seen.get(column, insert.get(column, new))
        return (
            F.when(in_batch & known, on_update.cast(kind)).when(in_batch, on_new.cast(kind))
            .otherwise(old.cast(kind))
        )

    columns = [
        F.col("source_local_id") if c == "source_local_id" else value(c, t).alias(c)
        for c, t in STORE_COLUMNS.items()
    ]
    change = (
        F.when(in_batch & known, "updated").when(in_batch, "inserted").otherwise("untouched").alias("change")
    )
    return joined.select(*columns, change)


def upsert(stores: DataFrame, batch: DataFrame, source: str, run_id: Column, now: Column) -> DataFrame:
    """All stores after an upsert of one source."""
    rest = as_stores(stores.where(F.col("source_name") != source))
    return rest.unionByName(merge_source(stores, batch, source, run_id, now).drop("change"))


def activity_rows(stores: DataFrame, batch: DataFrame, source: str, old: DataFrame, target: Column) -> DataFrame:
    """Activities after a batch: those of its stores are replaced, the others kept."""
    ids = stores.where(F.col("source_name") == source).select(F.col("id").alias("store_id"), "source_local_id")
    fresh = (
        large_join(batch.select("source_local_id", F.explode("activities").alias("a")), ids, "source_local_id")
        .select(
            "store_id", F.col("a.code").alias("epigraph_code"),
            F.col("a.description").alias("epigraph_description"),
        )
        .withColumn("is_target_epigraph", target)
    )
    touched = large_join(batch.select("source_local_id"), ids, "source_local_id").select("store_id")
    return large_join(old, touched, "store_id", "left_anti").unionByName(fresh)


def deactivate_missing(stores: DataFrame, source: str, run_id: Column, now: Column | None = None) -> DataFrame:
    """Mark the source's rows a run did not see as possibly closed, once.

    Rows already marked stay as they are; the score is kept. Not for runs limited to a sample.
    """
    gone = (
        (F.col("source_name") == source)
        & ~F.col("last_import_run_id").eqNullSafe(run_id)
        & ~F.array_contains("badges", "posible_cerrado")
    )
    changes = {
        "badges": F.array_append("badges", F.lit("posible_cerrado")),
        "confidence_level": F.lit("excluded"),
    }
    if now is not None:
        changes["updated_at"] = now
    return stores.withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in changes.items()})


def prune_guard(stores: DataFrame, run_id: Column) -> DataFrame:
    """Seen, vanished and total active canonical rows, and whether pruning is safe."""
    active = stores.where("source_name = 'osm' and confidence_level <> 'excluded'")
    seen = F.col("last_import_run_id").eqNullSafe(run_id)
    return active.agg(
        F.count_if(seen).alias("seen"), F.count_if(~seen).alias("vanished"), F.count(F.lit(1)).alias("active_total")
    ).withColumn(
        "prune",
        (F.col("seen") > 0) & (F.col("vanished") > 0)
        & (F.col("vanished") <= F.col("active_total") * F.lit(MAX_PRUNE_FRACTION)),
    )


def prune_vanished(stores: DataFrame, run_id: Column) -> DataFrame:
    """Hide canonical rows missing from a whole-country run, unless too many are missing.

    The guard is a single row, taken as a scalar inside the same plan.
    """
    safe = prune_guard(stores, run_id).select("prune").scalar()
    gone = (
        (F.col("source_name") == "osm")
        & (F.col("confidence_level") != "excluded")
        & ~F.col("last_import_run_id").eqNullSafe(run_id)
        & safe
    )
    changes = {
        "confidence_level": F.lit("excluded"), "is_published": F.lit(False),
        "publication_reason": F.lit("osm_missing_latest_extract"),
    }
    # The test is computed once: later columns must not see the changed level.
    marked = stores.withColumn("_gone", gone)
    return marked.withColumns(
        {c: F.when(F.col("_gone"), v).otherwise(F.col(c)) for c, v in changes.items()}
    ).drop("_gone")


def _closed_or_unconfirmed() -> Column:
    status = F.lower(F.coalesce("official_status", F.lit("")))
    closed = F.array_contains("badges", "posible_cerrado") | status.isin(CLOSED_STATUS)
    return F.when(closed, "censo_source_closed").otherwise("censo_only_unconfirmed")


def apply_matches(stores: DataFrame, matches: DataFrame) -> DataFrame:
    """Set the evidence of accepted matches on canonical rows and mark their register rows.

    Both kinds of row meet their match in one join on the unique id.
    """
    empty = {c: F.lit(None).cast(STORE_COLUMNS[c]) for c in EVIDENCE}
    filled = {
        "matched_censo_source": F.col("censo_source"), "matched_censo_local_id": F.col("censo_local_id"),
        "censo_match_version": F.col("match_version"), "censo_match_method": F.col("method"),
        "censo_match_distance_m": F.col("distance_m"), "censo_match_name_similarity": F.col("name_similarity"),
    }
    evidence = matches.select(
        F.col("osm_id").alias("id"), F.struct(*[v.cast(STORE_COLUMNS[c]).alias(c) for c, v in filled.items()]).alias("_e")
    )
    marks = matches.select(
        F.col("censo_id").alias("id"), F.struct(*[v.alias(c) for c, v in empty.items()]).alias("_e")
    )
    joined = large_join(stores, evidence.unionByName(marks), "id", "left")
    matched = F.col("_e").isNotNull()
    canonical = matched & (F.col("source_name") == "osm")
    out = {c: F.when(canonical, F.col(f"_e.{c}")).otherwise(F.col(c)) for c in EVIDENCE}
    out["badges"] = F.when(
        canonical, F.array_append(F.array_remove("badges", "oficial"), F.lit("oficial"))
    ).otherwise(F.col("badges"))
    out["publication_reason"] = F.when(matched & ~canonical, "matched_to_osm").otherwise(F.col("publication_reason"))
    return joined.withColumns(out).drop("_e")


def refine(stores: DataFrame, matches: DataFrame) -> DataFrame:
    """Serving policy, then match evidence rebuilt from scratch.

    Register and fixture rows are hidden with a reason; active canonical rows are published, and
    the fields and evidence older merges left on them are cleared.
    """
    source, level = F.col("source_name"), F.col("confidence_level")
    census, fixture, osm = source.startswith("censo_"), source == FIXTURE_SOURCE, source == "osm"
    changes = {
        "is_published": F.when(census | fixture, False).when(osm, level != "excluded").otherwise(F.col("is_published")),
        "publication_reason": F.when(census, _closed_or_unconfirmed())
        .when(fixture, "development_fixture")
        .when(osm & (level == "excluded"), "osm_missing_latest_extract")
        .when(osm, F.lit(None)).otherwise(F.col("publication_reason")),
        "badges": F.when(osm, F.array_remove("badges", "oficial")).otherwise(F.col("badges")),
    }
    for column in [*_OSM_CLEARED, *EVIDENCE]:
        changes[column] = F.when(~osm, F.col(column))
    return apply_matches(stores.withColumns(changes), matches)


def publication_counts(stores: DataFrame) -> DataFrame:
    """Published canonical rows, hidden register rows and hidden fixtures."""
    source, shown = F.col("source_name"), F.col("is_published")
    return stores.agg(
        F.count_if((source == "osm") & shown).alias("published_osm"),
        F.count_if(source.startswith("censo_") & ~shown).alias("hidden_censo"),
        F.count_if((source == FIXTURE_SOURCE) & ~shown).alias("hidden_fixtures"),
    )


# --- one-off backfills --------------------------------------------------------


def publication_baseline(stores: DataFrame) -> DataFrame:
    """First-time publication state: active canonical rows shown, reasons on the rest."""
    source, level = F.col("source_name"), F.col("confidence_level")
    osm = source == "osm"
    return stores.withColumns({
        "is_published": F.when(osm & (level != "excluded"), True).otherwise(F.lit(False)),
        "publication_reason": F.when(osm & (level != "excluded"), F.lit(None))
        .when(osm, "osm_missing_latest_extract")
        .when(source.startswith("censo_"), _closed_or_unconfirmed())
        .when(source == FIXTURE_SOURCE, "development_fixture").otherwise("censo_only_unconfirmed"),
        "badges": F.when(osm, F.array_remove("badges", "oficial")).otherwise(F.col("badges")),
    })


def rename_source(stores: DataFrame, old: str, new: str) -> DataFrame:
    """Give a source its new name."""
    return stores.withColumn("source_name", F.when(F.col("source_name") == old, new).otherwise(F.col("source_name")))


def clear_stale_fields(stores: DataFrame) -> DataFrame:
    """Drop register fields once copied onto canonical rows, the address included."""
    keep = F.col("source_name") != "osm"
    return stores.withColumns({c: F.when(keep, F.col(c)) for c in ["address", *_OSM_CLEARED]})

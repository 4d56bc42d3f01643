"""Snapshot changes and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.classes import patterns, tag_map, SQL_OSM_KEEP, SQL_OSM_TYPE, _NAME_BCN
from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_in_box, sql_name
from barrio.operators import match
from barrio.operators.keyed import large_join
from barrio.plans import ingest, snapshot
from barrio.session import new_path
from barrio.sources import sinks

RUN = 9_000_001
NOW = "2026-06-03 10:00:00"


def _run():
    return F.lit(RUN).cast("bigint")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- register upsert ----------------------------------------------------------

part(
    "bcn_batch",
    f"select ID_Global as slid, {_NAME_BCN} as name, {sql_name(_NAME_BCN)} as nname, nullif(trim(Nom_Districte), '') as district, nullif(trim(Nom_Barri), '') as barri, t, onsite, takeaway, "
    f"confidence_score, confidence_level, badges, is_chain, lat, lng from (@bcn_class) where {sql_in_box('barcelona')}",
)
part("bcn_known", "select * from (@fx_places) where source_name = 'censo_barcelona'")
part(
    "bcn_next",
    "select coalesce(b.slid, p.source_local_id) as source_local_id, case when b.slid is null then p.name else b.name end as name, case when b.slid is null then p.district else b.district end as district, "
    "case when b.slid is null then p.neighbourhood else b.barri end as neighbourhood, case when b.slid is null then p.place_type else b.t end as place_type, "
    "case when b.slid is null then p.badge_list else b.badges end as badges, case when b.slid is null then p.confidence_level else b.confidence_level end as confidence_level, "
    "case when b.slid is null then p.official_status when p.id is not null then p.official_status end as official_status, "
    "case when b.slid is null then p.last_import_run_id else 9000001 end as last_import_run_id, case when p.id is null then false else p.is_published end as is_published, "
    "case when p.id is null then 'censo_only_unconfirmed' else p.publication_reason end as publication_reason, "
    "case when b.slid is not null and p.id is not null then 'updated' when b.slid is not null then 'inserted' else 'untouched' end as change "
    "from (@bcn_known) p full join (@bcn_batch) b on b.slid = p.source_local_id",
)


def _bcn(d: Data):
    batch = ingest.barcelona_batch(d.fx_bcn_rows, patterns(d))
    return snapshot.merge_source(d.stores, batch, "censo_barcelona", _run(), _now())


@query("u1_censo_upsert", "select * from (@bcn_next)")
def _(d: Data):
    return _bcn(d).select(
        "source_local_id", "name", "district", "neighbourhood", "place_type", F.array_join("badges", ",").alias("badges"),
        "confidence_level", "official_status", "last_import_run_id", "is_published", "publication_reason", "change",
    )


@query(
    "u3_soft_deactivate",
    "select source_local_id, case when gone then concat_ws(',', nullif(badges, ''), 'posible_cerrado') else badges end as badges, case when gone then 'excluded' else confidence_level end as confidence_level from ("
    "select *, coalesce(last_import_run_id <> 9000001, true) and not contains(badges, 'posible_cerrado') as gone from (@bcn_next))",
)
def _(d: Data):
    after = snapshot.deactivate_missing(_bcn(d), "censo_barcelona", _run())
    return after.select("source_local_id", F.array_join("badges", ",").alias("badges"), "confidence_level")


# --- map upsert and prune -----------------------------------------------------

part(
    "osm_new",
    f"select case when n % 20 = 1 then concat('w', cast(n as varchar)) else concat('n', cast(n as varchar)) end as slid, coalesce(name, '') as name, {SQL_OSM_TYPE} as t, opening_hours, lat4 / 1e4 as lat, "
    f"coalesce(brand, '') <> '' or coalesce(brand_wikidata, '') <> '' as chain from (select *, cast(substr(id, 2) as bigint) as n from (@fx_osm_features)) where {SQL_OSM_KEEP}",
)
part(
    "osm_next",
    "select coalesce(b.slid, p.source_local_id) as source_local_id, case when b.slid is null then p.name else b.name end as name, case when b.slid is null then p.place_type else b.t end as place_type, "
    "case when b.slid is null then p.opening_hours_osm else b.opening_hours end as opening_hours_osm, p.opening_hours_web, coalesce(p.badge_list, '') as badges, "
    "case when b.slid is null then p.district end as district, case when b.slid is null then p.official_status end as official_status, "
    "case when b.slid is null then p.confidence_level when coalesce(b.opening_hours, '') <> '' then 'high' else 'medium' end as confidence_level, "
    "case when b.slid is null then p.is_chain else b.chain end as is_chain, case when b.slid is null then p.is_published else true end as is_published, "
    "case when b.slid is null then p.publication_reason end as publication_reason, case when b.slid is null then p.last_import_run_id else 9000001 end as last_import_run_id, "
    "coalesce(p.matched_censo_local_id, '') as matched, case when b.slid is not null and p.id is not null then 'updated' when b.slid is not null then 'inserted' else 'untouched' end as change "
    "from (select * from (@fx_places) where source_name = 'osm') p full join (@osm_new) b on b.slid = p.source_local_id",
)


def _osm_next(d: Data):
    """Features under the stored ids, one in twenty under a new one."""
    number = F.substring("id", 2, 20).cast("bigint")
    kind = F.when(number % 20 == 1, "w").otherwise("n")
    features = tag_map(d.fx_osm_features).select(
        F.concat(kind, number.cast("string")).alias("id"), "tags",
        (F.col("lat4") / 1e4).alias("lat"), (F.col("lng4") / 1e4).alias("lng"),
    )
    return snapshot.merge_source(d.stores, ingest.osm_batch(features), "osm", _run(), _now())


_OSM_OUT = [
    "source_local_id", "name", "place_type", "opening_hours_osm", "opening_hours_web", "badges", "district",
    "official_status", "confidence_level", "is_chain", "is_published", "publication_reason", "last_import_run_id",
    "matched", "change",
]


@query("u2_osm_upsert", f"select {', '.join(_OSM_OUT)} from (@osm_next)")
def _(d: Data):
    rows = _osm_next(d).withColumn("badges", F.array_join("badges", ","))
    return rows.withColumn("matched", F.coalesce("matched_censo_local_id", F.lit(""))).select(*_OSM_OUT)


def _after_run(d: Data, modulus: int):
    """Stores after a run that saw all but one in `modulus` canonical rows."""
    seen = (F.col("source_name") == "osm") & (F.col("id") % modulus != 0)
    return d.stores.withColumn("last_import_run_id", F.when(seen, _run()).otherwise(F.col("last_import_run_id")))


def _prune_sql(modulus: int) -> str:
    return (
        f"select id, case when gone then 'excluded' else confidence_level end as confidence_level, case when gone then false else is_published end as is_published, "
        "case when gone then 'osm_missing_latest_extract' else publication_reason end as publication_reason from (select *, source_name = 'osm' and confidence_level <> 'excluded' and not seen and "
        "(select count_if(seen2) > 0 and count_if(not seen2) > 0 and count_if(not seen2) <= 0.15 * count(*) from "
        f"(select id % {modulus} <> 0 as seen2 from (@fx_places) where source_name = 'osm' and confidence_level <> 'excluded')) as gone from (select *, source_name = 'osm' and id % {modulus} <> 0 as seen from (@fx_places)))"
    )


@query("u4_guarded_prune", _prune_sql(11))
def _(d: Data):
    return snapshot.prune_vanished(_after_run(d, 11), _run()).select(
        "id", "confidence_level", "is_published", "publication_reason"
    )


@query("u4b_prune_skipped", _prune_sql(3))
def _(d: Data):
    return snapshot.prune_vanished(_after_run(d, 3), _run()).select(
        "id", "confidence_level", "is_published", "publication_reason"
    )


# --- refinement ---------------------------------------------------------------

_CLOSED = "(list_contains(string_split(badge_list, ','), 'posible_cerrado') or lower(coalesce(official_status, '')) in ('cerrado', 'baja', 'baja r'))"
part(
    "refined",
    "select s.id, s.source_name, case when s.source_name = 'osm' then s.confidence_level <> 'excluded' else false end as is_published, "
    f"case when mc.censo_id is not null then 'matched_to_osm' when s.source_name = 'madrid_sample_fixture' then 'development_fixture' when s.source_name = 'osm' and s.confidence_level = 'excluded' then 'osm_missing_latest_extract' "
    f"when s.source_name = 'osm' then null when {_CLOSED} then 'censo_source_closed' else 'censo_only_unconfirmed' end as publication_reason, "
    "case when s.source_name <> 'osm' then s.badge_list when mo.osm_id is not null then concat_ws(',', nullif(array_to_string(list_filter(string_split(s.badge_list, ','), lambda x: x not in ('oficial', '')), ','), ''), 'oficial') "
    "else array_to_string(list_filter(string_split(s.badge_list, ','), lambda x: x not in ('oficial', '')), ',') end as badges, case when s.source_name <> 'osm' then s.district end as district, "
    "mo.censo_source as matched_censo_source, mo.censo_local_id as matched_censo_local_id, mo.method as censo_match_method, round(mo.distance_m, 2) as censo_match_distance_m "
    "from (@fx_places) s left join (@accepted) mo on mo.osm_id = s.id and s.source_name = 'osm' left join (@accepted) mc on mc.censo_id = s.id and s.source_name <> 'osm'",
)


def _refined_out(df):
    return df.select(
        "id", "source_name", "is_published", "publication_reason", F.array_join("badges", ",").alias("badges"), "district",
        "matched_censo_source", "matched_censo_local_id", "censo_match_method",
        F.round("censo_match_distance_m", 2).alias("censo_match_distance_m"),
    )


@query("u5_refinement_policy", "select * from (@refined)")
def _(d: Data):
    return _refined_out(snapshot.refine(d.stores, match.accepted_matches(d.stores)))


@query(
    "j12_match_apply",
    "select id, matched_censo_source, matched_censo_local_id, censo_match_method from (@refined) where source_name = 'osm' and matched_censo_source is not null",
)
def _(d: Data):
    matches = match.accepted_matches(d.stores)
    applied = snapshot.apply_matches(d.stores.drop(*snapshot.EVIDENCE).select(
        "*", *[F.lit(None).cast(snapshot.STORE_COLUMNS[c]).alias(c) for c in snapshot.EVIDENCE]
    ), matches)
    return applied.where("matched_censo_source is not null").select(
        "id", "matched_censo_source", "matched_censo_local_id", "censo_match_method"
    )


@query(
    "u6_backfills",
    "select id, case when source_name = 'censo_diba' then 'censo_province' else source_name end as source_name, source_name = 'osm' and confidence_level <> 'excluded' as is_published, "
    "case when source_name = 'osm' and confidence_level <> 'excluded' then null when source_name = 'osm' then 'osm_missing_latest_extract' when source_name = 'madrid_sample_fixture' then 'development_fixture' "
    f"when {_CLOSED} then 'censo_source_closed' else 'censo_only_unconfirmed' end as publication_reason, case when source_name <> 'osm' then address end as address, case when source_name <> 'osm' then official_status end as official_status from (@fx_places)",
)
def _(d: Data):
    rows = snapshot.clear_stale_fields(snapshot.publication_baseline(d.stores))
    return snapshot.rename_source(rows, "censo_diba", "censo_province").select(
        "id", "source_name", "is_published", "publication_reason", "address", "official_status"
    )


# --- ledger, publish, history -------------------------------------------------


@query(
    "u7_run_ledger",
    "select id as run_id, source_name, status, case when status = 'succeeded' then id % 1000 end as row_count, case when status = 'failed' then 'boom' end as error_message from (@fx_import_runs)",
)
def _(d: Data):
    runs = d.fx_import_runs
    facts = (F.col("id"), F.col("source_name"), F.col("file_hash"))
    path = new_path(d.spark, "ledger")
    sinks.append_rows(runs.select(*sinks.start_event(*facts, F.col("started_at"))), path)
    done, failed = F.col("status") == "succeeded", F.col("status") == "failed"
    end = F.timestamp_add("MINUTE", F.lit(5), F.col("started_at"))
    closing = sinks.finish_event(
        *facts, end, F.col("status"), rows=F.when(done, F.col("id") % 1000), error=F.when(failed, F.lit("boom"))
    )
    sinks.append_rows(runs.select(*closing), path)
    latest = sinks.latest_runs(d.spark.read.parquet(path))
    return latest.select("run_id", "source_name", "status", "row_count", "error_message")


@query(
    "u8_snapshot_publish",
    "select 2 as version, (select count(*) from (@fx_import_runs)) as import_runs, (select count(*) from (@fx_places)) as stores, (select count(*) from (@fx_places)) as store_activities, true as valid, "
    "(select count(*) from (@fx_places) where source_name = 'osm') as readable_osm",
)
def _(d: Data):
    """A sound version, then a broken one with orphans; readers stay on the sound one."""
    root = new_path(d.spark, "snapshots")
    runs, stores = d.fx_import_runs, d.stores
    # Each run that stores name is looked up once; a run behind a tenth of all stores is a single row of that join.
    used = stores.select("last_import_run_id").distinct()
    known = large_join(used, runs.select(F.col("id").alias("last_import_run_id")), "last_import_run_id")
    sound = stores.join(known.withColumn("_known", F.lit(True)), "last_import_run_id", "left").withColumn(
        "last_import_run_id", F.when(F.col("_known"), F.col("last_import_run_id"))
    ).drop("_known")
    acts = stores.select(F.col("id").alias("store_id"), F.lit("561001").alias("epigraph_code"))
    tables = {"import_runs": runs, "stores": snapshot.as_stores(sound), "store_activities": acts}
    pointer = sinks.publish_snapshot(tables, root, 2)
    broken = {**tables, "store_activities": acts.withColumn("store_id", F.col("store_id") + 50_000_000)}
    sinks.publish_snapshot(broken, root, 3)
    served = sinks.read_snapshot(d.spark, root, "stores").where("source_name = 'osm'")
    readable = served.agg(F.count(F.lit(1))).scalar()
    return pointer.select(
        F.col("version").cast("int").alias("version"), "import_runs", "stores", "store_activities", "valid",
        readable.alias("readable_osm"),
    )


@query(
    "u9_refresh_history",
    "select '2026-06-03 10:00' as started_at, '2026-06-03 10:06' as ended_at, 6.5e0 as duration_min, 'FAILED: a; b' as status, 'no' as pushed, count_if(a)::bigint as active_stores, "
    "count_if(a and (opening_hours_osm is not null or opening_hours_web is not null))::bigint as stores_with_hours from (select *, is_published and confidence_level <> 'excluded' as a from (@fx_places))",
)
def _(d: Data):
    end = F.lit("2026-06-03 10:06:30").cast("timestamp_ntz")
    row = sinks.refresh_row(_now(), end, F.lit("FAILED: a, b"), F.lit("no"), d.stores)
    path = new_path(d.spark, "history")
    sinks.append_rows(row, path)
    return d.spark.read.parquet(path)

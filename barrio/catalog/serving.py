"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.hours import sql_verdict
from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_distance
from barrio.operators import crawl, serve
from barrio.operators.census import madrid_candidates
from barrio.operators.keyed import large_join

RADIUS = 5000.0

part("served_osm", "select * from (@effective) where is_published and confidence_level <> 'excluded'")
part(
    "in_radius",
    "select * from (select q.query_id, o.*, " + sql_distance("q.lat", "q.lng", "o.lat", "o.lng") + " as distance_m from (@fx_query_points) q join (@served_osm) o "
    "on o.lat between q.lat - 0.046 and q.lat + 0.046 and o.lng between q.lng - 0.0625 and q.lng + 0.0625) where distance_m <= 5000",
)
part(
    "nearest",
    "select * from (select *, row_number() over (partition by query_id order by distance_m, id) as position from (@in_radius))",
)


def _points(d: Data):
    return d.fx_query_points


@query("j2_nearest_per_query_point", "select query_id, id, position, round(distance_m, 2) as distance_m from (@nearest) where position <= 50")
def _(d: Data):
    spots = serve.asked_spots(_points(d))
    near = serve.nearest_places(spots, serve.served(d.stores).select("id", "lat", "lng"), F.lit(RADIUS), 50, RADIUS)
    rows = near.select("query_id", "id", "position", "distance_m")
    return serve.for_every_query(_points(d), spots, rows).select(
        "query_id", "id", F.col("position").cast("bigint").alias("position"),
        F.round("distance_m", 2).alias("distance_m"),
    )


part(
    "in_view",
    "select v.view_id, v.cell, o.* from (@fx_viewports) v join (@served_osm) o on o.lat between v.south and v.north and o.lng between v.west and v.east",
)


@query("j3_places_in_view", "select view_id, id from (@in_view)")
def _(d: Data):
    places = serve.served(d.stores).select("id", "lat", "lng")
    return serve.places_in_view(d.fx_viewports, places).select("view_id", "id")


@query(
    "j4_evidence_lookup",
    "select id, address, district, neighbourhood, found from (@filled) where matched",
)
def _(d: Data):
    matched = d.stores.where("matched_censo_source is not null")
    own = matched.select("id", F.col("address").alias("_own"))
    out = serve.with_evidence(matched.withColumn("address", F.lit(None).cast("string")), d.stores)
    # The register address alone tells whether the evidence row exists.
    out = large_join(out.select("id", F.col("address").alias("_other"), "district", "neighbourhood"), own, "id")
    other = d.stores.where(F.col("source_name").startswith("censo_")).select(
        F.col("source_name").alias("matched_censo_source"), F.col("source_local_id").alias("matched_censo_local_id"),
        F.lit(True).alias("found"),
    )
    flags = large_join(matched, other, ["matched_censo_source", "matched_censo_local_id"], "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("found")
    )
    return large_join(out, flags, "id").select(
        "id", serve.fallback(F.col("_own"), F.col("_other")).alias("address"), "district", "neighbourhood", "found"
    )


part(
    "candidates",
    "select *, o and (p = 'bar' or (take and not ban)) as sells, case when source_name = 'osm' then 0 else 1 end as tier from (select n.query_id, n.id, n.position, n.distance_m, n.source_name, n.name, "
    "case when n.matched_censo_source is not null then 'verified' else 'mapped' end as verification, "
    "n.place_type as p, n.sells_takeaway_beer as take, n.hours_source as src, f.day_min >= 1320 or f.day_min < 540 as ban, r.schedule is not null as o, "
    "case when r.until_min is not null then concat(lpad(cast((r.until_min % 1440) // 60 as varchar), 2, '0'), ':', lpad(cast(r.until_min % 60 as varchar), 2, '0')) end as closes_at "
    "from (@nearest) n join (@local_instants) f on f.query_id = n.query_id left join (@open_rows) r on r.schedule = n.hours and f.week_min >= r.start_min and f.week_min < r.end_min)",
)


@query(
    "w4_trust_ranking",
    "select query_id, id, row_number() over (partition by query_id order by case when id % 3 = 0 then 1 else 0 end, floor(distance_m + 0.5), position) as trust_rank from (@nearest) where position <= 20",
)
def _(d: Data):
    spots = serve.asked_spots(_points(d))
    near = serve.nearest_places(spots, serve.served(d.stores).select("id", "lat", "lng"), F.lit(RADIUS), 20, RADIUS)
    kind = F.when(F.col("id") % 3 == 0, "unverified").otherwise("mapped")
    ranked = serve.trust_ranking(near.withColumn("verification", kind))
    rows = ranked.select("query_id", "id", F.col("trust_rank").cast("bigint").alias("trust_rank"))
    return serve.for_every_query(_points(d), spots, rows)


def _nearest_open(d: Data, radius: float):
    rows = serve.nearest_open(_points(d), d.stores, F.lit(radius), 10)
    return rows.select(
        "query_id", "id", "name", "place_type", "verification", F.col("trust_rank").cast("bigint").alias("trust_rank"),
        F.floor(F.col("distance_m") + F.lit(0.5)).alias("distance_m"), "open_now.closes_at", "open_now.reason",
        "open_now.hours_source",
    )


@query(
    "w5_nearest_open",
    "select query_id, id, name, place_type, verification, trust_rank, distance_m, closes_at, reason, hours_source from (select query_id, id, name, p as place_type, verification, "
    "row_number() over (partition by query_id order by tier, floor(distance_m + 0.5), position) as trust_rank, cast(floor(distance_m + 0.5) as bigint) as distance_m, closes_at, "
    + sql_verdict() + " as reason, src as hours_source from (@candidates) where sells) where trust_rank <= 10",
)
def _(d: Data):
    return _nearest_open(d, RADIUS)


@query(
    "w5_nearest_open_default",
    "select query_id, id, name, place_type, verification, trust_rank, distance_m, closes_at, reason, hours_source from (select query_id, id, name, p as place_type, verification, "
    "row_number() over (partition by query_id order by tier, floor(distance_m + 0.5), position) as trust_rank, cast(floor(distance_m + 0.5) as bigint) as distance_m, closes_at, "
    + sql_verdict() + " as reason, src as hours_source from (@candidates) where sells and distance_m <= 1000) where trust_rank <= 10",
)
def _(d: Data):
    # What a request that names no radius gets.
    return _nearest_open(d, float(serve.DEFAULTS["radius_m"]))


@query(
    "w5_nearest_open_far",
    "select query_id, id, name, place_type, verification, trust_rank, distance_m, closes_at, reason, hours_source from (select query_id, id, name, p as place_type, verification, "
    "row_number() over (partition by query_id order by tier, floor(distance_m + 0.5), position) as trust_rank, cast(floor(distance_m + 0.5) as bigint) as distance_m, closes_at, "
    + sql_verdict() + " as reason, src as hours_source from (@candidates) where sells) where trust_rank <= 10",
)
def _(d: Data):
    # The largest radius that a request may ask for.
    return _nearest_open(d, RADIUS)


part(
    "requests",
    "select *, case when k % 4 = 0 then 'consume_aqui' when k % 4 = 1 then 'para_llevar' end as intent, case when k % 5 = 0 then 'bar,bodega' end as types, k % 3 = 0 as hide_chains, "
    "case when k % 7 = 0 then 'high' end as confidence, k % 2 = 0 as open_now, 500 + (k % 10) * 500 as radius_m, 5 + k % 20 as lim from (select *, query_id // 50 as k from (@fx_query_points))",
)


@query(
    "n30_nearby_requests",
    "select query_id, id, verification, address, district, neighbourhood, prohibited, row_number() over (partition by query_id order by tier, floor(distance_m + 0.5), distance_m, id) as trust_rank, "
    "cast(floor(distance_m + 0.5) as bigint) as distance_m, sells as sells_beer_now, reason from (select *, row_number() over (partition by query_id order by case when open_now then tier else 0 end, "
    "case when open_now then floor(distance_m + 0.5) else 0 end, distance_m, id) as place from (select c.query_id, c.id, c.distance_m, c.verification, c.tier, coalesce(c.sells, false) as sells, c.ban as prohibited, "
    "f.address, f.district, f.neighbourhood, q.open_now, q.lim, " + sql_verdict() + " as reason "
    "from (@candidates) c join (@requests) q on q.query_id = c.query_id join (@fx_places) s on s.id = c.id join (@filled) f on f.id = c.id where c.distance_m <= q.radius_m "
    "and (q.intent is null or case when q.intent = 'consume_aqui' then s.sells_onsite_beer else s.sells_takeaway_beer end) and (q.types is null or list_contains(string_split(q.types, ','), s.place_type)) "
    "and not (q.hide_chains and s.is_chain) and (q.confidence is null or s.confidence_level = q.confidence) and (not q.open_now or c.sells))) where place <= lim",
)
def _(d: Data):
    k = F.floor(F.col("query_id") / 50)
    requests = _points(d).select(
        "query_id", "lat", "lng", "at_time", F.when(k % 4 == 0, "consume_aqui").when(k % 4 == 1, "para_llevar").alias("intent"),
        F.when(k % 5 == 0, F.array(F.lit("bar"), F.lit("bodega"))).alias("place_types"), (k % 3 == 0).alias("hide_chains"),
        F.when(k % 7 == 0, "high").alias("confidence"), (k % 2 == 0).alias("open_now"), (500 + (k % 10) * 500).alias("radius_m"),
        (5 + k % 20).cast("int").alias("limit"),
    )
    rows = serve.with_evidence(serve.nearby(requests, d.stores, RADIUS), d.stores)
    return rows.select(
        "query_id", "id", "verification", "address", "district", "neighbourhood", F.col("takeaway_prohibited").alias("prohibited"),
        F.col("trust_rank").cast("bigint").alias("trust_rank"), F.floor(F.col("distance_m") + F.lit(0.5)).alias("distance_m"),
        "open_now.sells_beer_now", "open_now.reason",
    )


part(
    "sampled",
    "select * from (select *, row_number() over (partition by view_id order by md5(cast(id as varchar)), id) as sample_rank from (@in_view)) where sample_rank <= 100",
)


@query(
    "w6_map_sample",
    "select view_id, id, sample_rank from (select s.*, r.schedule is not null and (s.place_type = 'bar' or s.sells_takeaway_beer) as sells from (@sampled) s "
    "left join (@open_rows) r on r.schedule = s.hours and 3570 >= r.start_min and 3570 < r.end_min) where sells",
)
def _(d: Data):
    # Wednesday 2026-06-03 at 11:30 local time.
    views = d.fx_viewports.withColumn("at_time", F.lit("2026-06-03 09:30:00").cast("timestamp_ntz"))
    rows = serve.open_map_sample(views, d.stores, 100)
    return rows.select("view_id", "id", F.col("sample_rank").cast("bigint").alias("sample_rank"))


@query(
    "w7_ordered_limits",
    "select 'run' as kind, cast(id as varchar) as key from (select id from (@fx_import_runs) order by id desc limit 30) union all "
    "select 'url', website from (select distinct website from (@fx_store_sites) where website is not null order by website limit 40) union all "
    "select 'candidate', id_local from (select id_local from (@madrid_candidate_rows) order by id_local limit 50)",
)
def _(d: Data):
    runs = d.fx_import_runs.orderBy(F.desc("id")).limit(30).select(F.lit("run").alias("kind"), F.col("id").cast("string").alias("key"))
    sites = d.fx_store_sites.select("website").distinct().withColumn("status", F.lit("queued"))
    queue = crawl.crawl_queue(sites.select("*", F.lit(None).alias("host"), F.lit(None).alias("ids")), 40)
    first = madrid_candidates(madrid_rows(d), 50)
    return runs.union(queue.select(F.lit("url"), "website")).union(first.select(F.lit("candidate"), "id_local"))


def madrid_rows(d: Data):
    """The register projection with the columns it lacks as nulls."""
    rows = d.fx_madrid_rows
    absent = [
        "desc_distrito_local", "desc_barrio_local", "clase_vial_edificio", "desc_vial_edificio", "num_edificio", "cal_edificio",
    ]
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])


@query(
    "g3_dataset_meta",
    "select strftime(max(case when shown then last_seen_osm_at end), '%Y-%m-%d') as data_updated_at, count_if(shown)::bigint as active_stores, "
    "count_if(shown and (opening_hours_osm is not null or opening_hours_web is not null))::bigint as stores_with_hours from (select *, is_published and confidence_level <> 'excluded' as shown from (@fx_places))",
)
def _(d: Data):
    meta = serve.dataset_meta(d.stores)
    return meta.withColumn("data_updated_at", F.date_format("data_updated_at", "yyyy-MM-dd"))


@query(
    "g4_grid_clusters",
    "select view_id, cast(floor(lng / cell) as bigint) as cell_x, cast(floor(lat / cell) as bigint) as cell_y, round(avg(lng), 6) as lng, round(avg(lat), 6) as lat, count(*) as n from (@in_view) group by 1, 2, 3",
)
def _(d: Data):
    clusters = serve.grid_clusters(d.fx_viewports, serve.served(d.stores))
    return clusters.withColumn("lng", F.round("lng", 6)).withColumn("lat", F.round("lat", 6))

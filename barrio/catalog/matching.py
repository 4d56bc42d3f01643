"""Entity resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_compatible, sql_dice, sql_distance, sql_generic
from barrio.operators import match

_D = sql_distance("c.lat", "c.lng", "o.lat", "o.lng")

part(
    "usable_censo",
    "select * from (@fx_places) where source_name like 'censo%' and place_type is not null and (sells_onsite_beer or sells_takeaway_beer) "
    "and not list_contains(string_split(badge_list, ','), 'posible_cerrado') and lower(coalesce(official_status, '')) not in ('cerrado', 'baja', 'baja r')",
)
part("active_osm", "select * from (@fx_places) where source_name = 'osm' and confidence_level <> 'excluded'")
part("any_censo", "select * from (@fx_places) where source_name like 'censo%'")


def sql_near(osm: str, censo: str, radius: float) -> str:
    """Pairs within a radius, pre-cut by a degree box."""
    dlat, dlng = radius / 110000, radius / 80000
    return (
        f"select * from (select o.id as osm_id, c.id as censo_id, c.source_name as censo_source, c.source_local_id as censo_local_id, o.normalized_name as osm_name, "
        f"c.normalized_name as censo_name, o.place_type as osm_type, c.place_type as censo_type, {_D} as distance_m from (@{osm}) o join (@{censo}) c "
        f"on c.lat between o.lat - {dlat} and o.lat + {dlat} and c.lng between o.lng - {dlng} and o.lng + {dlng}) where distance_m <= {radius}"
    )


part("pairs", sql_near("active_osm", "usable_censo", 30))
part(
    "qualified",
    "select * from (select *, case when osm_name = censo_name then 'exact_name' when s >= 0.8 and distance_m <= 20 then 'strong_name' "
    "when s >= 0.6 and distance_m <= 10 then 'name_and_type' end as method from (select *, " + sql_dice("osm_name", "censo_name") + " as s from (@pairs) "
    f"where trim(osm_name) <> '' and trim(censo_name) <> '' and not {sql_generic('osm_name')} and not {sql_generic('censo_name')} and {sql_compatible('osm_type', 'censo_type')})) where method is not null",
)
part(
    "accepted",
    "select * from (select *, count(*) over (partition by osm_id) as no, count(*) over (partition by censo_id) as nc from (@qualified)) where no = 1 and nc = 1",
)


def _osm(d: Data):
    return match.active_osm(d.stores)


def _usable(d: Data):
    return match.usable_censo(d.stores)


def _any_censo(d: Data):
    return d.stores.where(F.col("source_name").startswith("censo_"))


@query("j1_candidate_pairs", "select osm_id, censo_id, round(distance_m, 2) as distance_m from (@pairs)")
def _(d: Data):
    return match.candidate_pairs(_osm(d), _usable(d)).select(
        "osm_id", "censo_id", F.round("distance_m", 2).alias("distance_m")
    )


_QUALIFIED = "osm_id, censo_id, round(distance_m, 2) as distance_m, method, round(s, 6) as name_similarity, 'censo-match-v2-high-precision' as match_version"


@query("w1_evaluate_pair", f"select {_QUALIFIED} from (@qualified)")
def _(d: Data):
    osm, censo = _osm(d), _usable(d)
    sites = match.qualified_sites(osm, censo)
    # Rounded before the sites are taken back to their rows, once per site pair.
    rounded = sites.withColumns({"distance_m": F.round("distance_m", 2), "name_similarity": F.round("name_similarity", 6)})
    return match.qualified_rows(rounded, osm, censo)


@query("w2_one_to_one", f"select {_QUALIFIED}, censo_source, censo_local_id from (@accepted)")
def _(d: Data):
    return (
        match.accepted_matches(d.stores)
        .withColumn("distance_m", F.round("distance_m", 2))
        .withColumn("name_similarity", F.round("name_similarity", 6))
    )


@query(
    "w3_best_match",
    "select osm_id, censo_id, case when osm_name <> '' and s >= 0.6 then 'both' else 'spatial' end as matched_by, round(distance_m, 2) as distance_m, round(s, 6) as score "
    "from (select *, row_number() over (partition by osm_id order by s desc, distance_m, censo_id) as r from (select *, " + sql_dice("osm_name", "censo_name") + " as s from (@pairs))) where r = 1",
)
def _(d: Data):
    best = match.best_matches(_osm(d), _usable(d))
    return best.withColumn("distance_m", F.round("distance_m", 2)).withColumn("score", F.round("score", 6))


@query(
    "g6_match_audit",
    "select 'candidate_pairs' as metric, count(*) as value from (@pairs) union all select 'osm_with_candidates', count(distinct osm_id) from (@pairs) "
    "union all select 'censo_with_candidates', count(distinct censo_id) from (@pairs) union all select 'evidence_qualified_pairs', count(*) from (@qualified) "
    "union all select 'ambiguous_osm', count(*) from (select osm_id from (@qualified) group by 1 having count(*) > 1) "
    "union all select 'ambiguous_censo', count(*) from (select censo_id from (@qualified) group by 1 having count(*) > 1) "
    "union all select 'accepted_matches', count(*) from (@accepted) union all select concat('source:', censo_source), count(*) from (@accepted) group by censo_source "
    "union all select concat('method:', method), count(*) from (@accepted) group by method "
    "union all select 'current_official_badges', count(*) from (@active_osm) where list_contains(string_split(badge_list, ','), 'oficial')",
)
def _(d: Data):
    return match.match_audit(d.stores)


part(
    "nearest_row",
    "select * from (select *, row_number() over (partition by osm_id order by distance_m, censo_id) as r from ("
    + sql_near("active_osm", "any_censo", 30) + ")) where r = 1",
)


def _nearest(d: Data):
    return match.nearest_register_row(_osm(d), _any_censo(d))


@query("j5_nearest_neighbour", "select osm_id, censo_id, round(distance_m, 2) as distance_m from (@nearest_row)")
def _(d: Data):
    return _nearest(d).select("osm_id", "censo_id", F.round("distance_m", 2).alias("distance_m"))


part("active_censo", "select * from (@any_censo) where confidence_level <> 'excluded'")


@query(
    "j6_proximity_existence",
    "select count(distinct censo_id) as overlap_candidates from (" + sql_near("active_osm", "active_censo", 30) + ")",
)
def _(d: Data):
    return match.overlap_candidates(_osm(d), _any_censo(d).where("confidence_level <> 'excluded'"))


@query(
    "j13_distance_bands",
    "select source_name, case when m < 10 then '<10 m' when m < 30 then '10-30 m' when m < 100 then '30-100 m' when m < 250 then '100-250 m' else '>=250 m' end as band, count(*) as n "
    "from (select c.id, any_value(c.source_name) as source_name, min(p.distance_m) as m from (@active_censo) c left join ("
    + sql_near("active_osm", "active_censo", 1000) + ") p on p.censo_id = c.id group by c.id) group by 1, 2",
)
def _(d: Data):
    return match.distance_bands(_osm(d), _any_censo(d).where("confidence_level <> 'excluded'"))


@query(
    "d5_merge_fan_out",
    "select count_if(n = 1)::bigint as used_once, count_if(n >= 2)::bigint as used_multiple, max(n) as max_osm_per_censo from (select censo_id, count(*) as n from (@nearest_row) group by 1)",
)
def _(d: Data):
    return match.fan_out(_nearest(d))


@query(
    "d6_type_mismatch",
    "select osm_type, censo_type, count(*) as n from (@nearest_row) where osm_type is distinct from censo_type group by 1, 2",
)
def _(d: Data):
    return match.type_mismatches(_nearest(d))


@query(
    "d7_overlap_candidates",
    "select source_name, count(*) as overlap_candidates from (select distinct censo_id, censo_source as source_name from (" + sql_near("active_osm", "active_censo", 30) + ")) group by 1",
)
def _(d: Data):
    active = _any_censo(d).where("confidence_level <> 'excluded'")
    return match.overlap_by_source(_osm(d), active)

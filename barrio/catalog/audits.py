"""Audit queries (D1 to D16) and register aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_list
from barrio.catalog.serving import madrid_rows
from barrio.functions.classify import TARGET_CODES
from barrio.operators import census
from barrio.plans import audit, snapshot
from barrio.sources.scans import MADRID_COLUMNS
from barrio.sources.sinks import orphan_counts

_NUM = "case when regexp_matches({0}, '^-?[0-9]+(\\.[0-9]+)?$') then cast({0} as double) end"
part(
    "madrid_kept",
    f"select *, {_NUM.format('coordenada_x_local')} as x, {_NUM.format('coordenada_y_local')} as y from (@fx_madrid_rows) where id_tipo_acceso_local = '1' and id_situacion_local = '1' and id_local <> ''",
)
part(
    "madrid_codes",
    "select id_local, nullif(id_epigrafe, '') as code, max(nullif(desc_epigrafe, '')) as description, max(rotulo) as rotulo, max(x) as x, max(y) as y, max(desc_situacion_local) as official_status from (@madrid_kept) "
    "where x between 420000 and 470000 and y between 4460000 and 4495000 group by 1, 2",
)
part(
    "madrid_candidate_rows",
    "select id_local, max(rotulo) as rotulo, max(x) as x, max(y) as y, max(official_status) as official_status, string_agg(code, ',' order by code) as codes from (@madrid_codes) "
    f"group by id_local having count_if(code in ({sql_list(TARGET_CODES)})) > 0",
)


@query("g1_madrid_candidates", "@madrid_candidate_rows")
def _(d: Data):
    return census.madrid_candidates(madrid_rows(d)).select(
        "id_local", "rotulo", "x", "y", "official_status", F.array_join("codes", ",").alias("codes")
    )


@query(
    "g2_activities_explode",
    "select id_local, code as epigraph_code, description as epigraph_description, code in (" + sql_list(TARGET_CODES) + ") as is_target_epigraph from (@madrid_codes) "
    "where code is not null and id_local in (select id_local from (@madrid_candidate_rows))",
)
def _(d: Data):
    return census.activities(census.madrid_candidates(madrid_rows(d)))


@query(
    "g5_run_summaries",
    "select 'place_type' as field, place_type as value, count(*) as n from (@fx_places) group by 2 union all select 'source_name', source_name, count(*) from (@fx_places) group by 2 "
    "union all select 'censo_match_method', censo_match_method, count(*) from (@fx_places) group by 2",
)
def _(d: Data):
    return audit.distribution(d.stores, ["place_type", "source_name", "censo_match_method"])


@query(
    "g7_publication_counts",
    "select count_if(source_name = 'osm' and is_published)::bigint as published_osm, count_if(source_name like 'censo%' and not is_published)::bigint as hidden_censo, "
    "count_if(source_name = 'madrid_sample_fixture' and not is_published)::bigint as hidden_fixtures from (@fx_places)",
)
def _(d: Data):
    return snapshot.publication_counts(d.stores)


@query(
    "g12_code_counts",
    "select 'situacion' as field, id_situacion_local as code, min(desc_situacion_local) as label, count(*) as n from (@fx_madrid_rows) group by 2 union all "
    "select 'epigrafe', id_epigrafe, min(trim(desc_epigrafe)), count(*) from (@fx_madrid_rows) group by 2",
)
def _(d: Data):
    rows = d.fx_madrid_rows
    one = census.code_counts(rows, "id_situacion_local", "desc_situacion_local").select(F.lit("situacion").alias("field"), "*")
    return one.union(census.code_counts(rows, "id_epigrafe", "desc_epigrafe").select(F.lit("epigrafe"), "*"))


_RUNS = "select id, started_at from (@fx_import_runs)"


@query(
    "j8_orphans",
    "select 'stores_without_run' as \"check\", count(*) as n from (@fx_places) s where last_import_run_id is not null and not exists (select 1 from (@fx_import_runs) r where r.id = s.last_import_run_id) "
    "union all select 'activities_without_store', count(*) from @lineitem l where not exists (select 1 from (@fx_places) s where s.id = l.l_partkey * 9)",
)
def _(d: Data):
    acts = d.lineitem.select((F.col("l_partkey") * 9).alias("store_id"))
    return orphan_counts(d.stores, d.fx_import_runs, acts)


@query(
    "d1_source_profile",
    "select 'rows' as metric, cast(count(*) as varchar) as value from (@fx_madrid_rows) union all select 'rows_with_coords', cast(count_if(coordenada_x_local <> '' and coordenada_y_local <> '') as varchar) from (@fx_madrid_rows) "
    "union all select 'rows_with_valid_coords', cast(count_if(try_cast(coordenada_x_local as double) between 420000 and 470000 and try_cast(coordenada_y_local as double) between 4460000 and 4495000) as varchar) from (@fx_madrid_rows) "
    f"union all select 'missing_columns', '{','.join(sorted(set(MADRID_COLUMNS) - {'id_local', 'rotulo', 'id_tipo_acceso_local', 'id_situacion_local', 'desc_situacion_local', 'coordenada_x_local', 'coordenada_y_local', 'id_epigrafe'}))}' "
    "union all select 'unexpected_columns', 'descripcion' union all select 'column_count', '9'",
)
def _(d: Data):
    return census.source_profile(d.fx_madrid_rows.withColumnRenamed("desc_epigrafe", "descripcion"), MADRID_COLUMNS)


@query(
    "d2_serving_counts",
    "select count(*) as physical, count_if(a)::bigint as active, count_if(not a)::bigint as excluded, count_if(a and (opening_hours_osm is not null or opening_hours_web is not null))::bigint as real_hours "
    "from (select *, confidence_level <> 'excluded' as a from (@fx_places))",
)
def _(d: Data):
    return audit.serving_counts(d.stores)


_HAS = "list_contains(string_split(badge_list, ','), '{0}')"


@query(
    "d3_existence_proxy",
    f"select case when source_name = 'osm' and {_HAS.format('oficial')} then 'verified' when source_name = 'osm' then 'mapped' else 'unverified' end as verification, count(*) as n from (@fx_places) where confidence_level <> 'excluded' group by 1",
)
def _(d: Data):
    return audit.existence_proxy(d.stores)


@query(
    "d4_missing_essentials",
    "select source_name, count_if(a)::bigint as active, count_if(a and coalesce(trim(name), '') = '')::bigint as blank_name, count_if(a and address is null)::bigint as no_address from (select *, confidence_level <> 'excluded' as a from (@fx_places)) group by 1",
)
def _(d: Data):
    return audit.missing_essentials(d.stores)


# Rows folded onto fewer points, so that exact copies exist.
@query(
    "d8_exact_duplicates",
    "select id, normalized_name, glat, glng, n from (select *, count(*) over (partition by normalized_name, glat, glng) as n from (select id, normalized_name, floor(lat * 20) as glat, floor(lng * 20) as glng from (@fx_places) where confidence_level <> 'excluded' and normalized_name <> '')) where n > 1",
)
def _(d: Data):
    floor = lambda c: F.floor(F.col(c) * 20).cast("double").alias(c)
    rows = d.stores.select("id", "normalized_name", "confidence_level", floor("lat"), floor("lng"))
    return audit.exact_duplicates(rows).select(
        "id", "normalized_name", F.col("lat").alias("glat"), F.col("lng").alias("glng"), "n"
    )


@query(
    "d9_reprocessed_runs",
    "select id, source_name, coalesce(lag(file_hash) over (partition by source_name order by id) = file_hash, false) as reprocessed from (@fx_import_runs)",
)
def _(d: Data):
    return audit.reprocessed_runs(d.fx_import_runs).select("id", "source_name", "reprocessed")


@query(
    "d10_distributions",
    " union all ".join(
        f"select '{c}' as field, {c} as value, count(*) as n from (@fx_places) where source_name like 'censo%' group by 2"
        for c in ("source_name", "confidence_level", "place_type", "scoring_version")
    ),
)
def _(d: Data):
    rows = d.stores.where(F.col("source_name").startswith("censo_"))
    return audit.distribution(rows, ["source_name", "confidence_level", "place_type", "scoring_version"])


@query(
    "d11_hours_coverage",
    "select source_name, count(opening_hours_osm) as with_hours, count(*) as total, round(100e0 * count(opening_hours_osm) / count(*), 1) as pct from (@fx_places) group by 1",
)
def _(d: Data):
    return audit.hours_coverage(d.stores)


@query(
    "d12_evidence_violations",
    "select 'evidence_fields' as \"check\", cast(id as varchar) as key from (@fx_places) where matched_censo_source is not null and (censo_match_method = 'guess' or censo_match_distance_m > 30) "
    "union all select 'source_key', concat(source_name, '|', source_local_id) from (@fx_places) group by source_name, source_local_id having count(*) > 1 "
    "union all select 'one_place_per_register_row', concat(matched_censo_source, '|', matched_censo_local_id) from (@fx_places) where matched_censo_source is not null group by matched_censo_source, matched_censo_local_id having count(*) > 1",
)
def _(d: Data):
    return audit.evidence_violations(d.stores)


@query(
    "d13_badge_consistency",
    f"select count_if({_HAS.format('oficial')} and matched_censo_source is null)::bigint as badge_without_evidence, count_if(not {_HAS.format('oficial')} and matched_censo_source is not null)::bigint as evidence_without_badge from (@fx_places) where source_name = 'osm'",
)
def _(d: Data):
    return audit.badge_consistency(d.stores)


@query(
    "d14_run_durations",
    "select id, source_name, status, cast(id % 977 as bigint) as duration_s from (@fx_import_runs) order by id desc limit 5",
)
def _(d: Data):
    end = F.timestamp_add("SECOND", (F.col("id") % 977).cast("int"), F.col("started_at"))
    return audit.run_durations(d.fx_import_runs.withColumn("finished_at", end)).select("id", "source_name", "status", "duration_s")


@query(
    "d15_spot_check",
    "select id, name, place_type, confidence_level from (@fx_places) where source_name = 'censo_madrid' and confidence_level <> 'excluded' order by (lat - 40.4168e0) * (lat - 40.4168e0) + (lng + 3.7038e0) * (lng + 3.7038e0), id limit 10",
)
def _(d: Data):
    return audit.spot_check(d.stores, "censo_madrid", 40.4168, -3.7038).select("id", "name", "place_type", "confidence_level")


@query(
    "d16_stale_sources",
    "select source_name, strftime(m, '%Y-%m-%d') as last_success, coalesce(timestamp '1998-08-10 12:00:00' - m >= (case when source_name = 'osm' then interval 31 day else interval 8 day end), true) as stale from ("
    "select source_name, max(case when status = 'succeeded' then started_at end) as m from (@fx_import_runs) group by 1)",
)
def _(d: Data):
    stale = audit.stale_sources(d.fx_import_runs, F.lit("1998-08-10 12:00:00").cast("timestamp_ntz"))
    return stale.withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd"))

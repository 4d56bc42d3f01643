"""Projections of the driver tables onto place-shaped tables.

Each text is valid in Spark SQL and in DuckDB; `@name` stands for a base table or another
projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = "bar,supermercado,alimentacion,bodega,tienda_24h,gasolinera,otro"

PROJECTIONS: dict[str, str] = {}

PROJECTIONS["fx_osm"] = f"""
select o_orderkey as id, concat('n', cast(o_orderkey as string)) as source_local_id,
 40e0 + ((p*7919)%7000)/1e4 + (o_orderkey%2)*12/111320e0 as lat, -42e-1 + ((p*104729)%12000)/1e4 as lng,
 split_part('{TYPES}', ',', cast(p%7+1 as int)) as place_type,
 concat_ws(' ', split_part('CASA,BAR,BODEGA,TABERNA,MESON', ',', cast(n%5+1 as int)), split_part('PACO,LOLA,MANOLO,PEPE,SOL,LUNA,MAR,RIO,NORTE,SUR,ALTA', ',', cast(n%11+1 as int)), case when o_orderkey%10=9 then 'CENTRO' end) as name,
 case when o_orderkey%3=0 then split_part('Mo-Su 09:00-22:00|24/7|Mo-Su 09:00-02:00|PH,Mo-Su 00:00-24:00|Mo-Sa 10:00-14:00,17:00-20:30|Mo-Th 09:00-01:00; Fr-Sa 09:00-02:00; Su 10:00-24:00|not a schedule', '|', cast(o_orderkey%7+1 as int)) end as opening_hours_osm,
 case when o_orderkey%17=0 then 'Mo-Fr 08:00-16:00' end as opening_hours_web,
 (o_orderkey%13=0) as is_chain, (o_orderkey%50<>7) as is_published,
 case when o_orderkey%3=0 then 'high' when o_orderkey%50=7 then 'excluded' else 'medium' end as confidence_level,
 o_orderdate as last_seen_osm_at
 from (select *, cast(floor(o_orderkey/2e0) as bigint) as p, case when o_orderkey%6=1 then o_orderkey-1 else o_orderkey end as n from @orders)
"""

PROJECTIONS["fx_censo"] = f"""
select 1000000+c_custkey as id, concat('censo_', split_part('madrid,barcelona,diba,andalucia', ',', cast(c_nationkey%4+1 as int))) as source_name, cast(c_custkey as string) as source_local_id,
 40e0 + ((p*7919)%7000)/1e4 + ((c_custkey*13)%40)/111320e0 as lat, -42e-1 + ((p*104729)%12000)/1e4 as lng,
 split_part('{TYPES}', ',', cast((p+case when c_custkey%9=0 then 1 else 0 end)%7+1 as int)) as place_type,
 concat_ws(' ', split_part('CASA,BAR,BODEGA,TABERNA,MESON', ',', cast((n+case when c_custkey%4=0 then 1 else 0 end)%5+1 as int)), split_part('PACO,LOLA,MANOLO,PEPE,SOL,LUNA,MAR,RIO,NORTE,SUR,ALTA', ',', cast(n%11+1 as int))) as name,
 concat('Calle ', cast(c_custkey as string)) as address, case when c_custkey%20=3 then 'Baja' else 'Abierto' end as official_status
 from (select *, c_custkey*5 as p, c_custkey*10 as n from @customer)
"""

PROJECTIONS["fx_access_log"] = """
select event_id, ts, concat('10.0.0.', cast(user_id%250 as string)) as remote_ip,
 case event_type when 'click' then concat('/api/stores/nearby?lat=', slat, '&lng=', slng, '&radius_m=3000')
  when 'view' then concat('/api/stores/map?north=', slat, '&south=', slat, '&east=', slng, '&west=', slng)
  when 'purchase' then concat('/api/stores/clusters?north=', slat, '&south=', slat, '&east=', slng, '&west=', slng, '&cell=0.05')
  else '/api/meta' end as uri
 from (select *, concat(cast(36+cast(floor(a/1e4) as bigint) as string), '.', lpad(cast(a%10000 as string),4,'0')) as slat,
   concat('-', cast(cast(floor(b/1e4) as bigint) as string), '.', lpad(cast(b%10000 as string),4,'0')) as slng
   from (select *, (event_id*7919)%70000 as a, (event_id*104729)%90000 as b from @events))
"""

PROJECTIONS["fx_pages"] = """
select page_id, url, concat(html, '<script type="application/ld+json">', case page_id%5
   when 0 then '{oops' when 1 then '{"@type":"WebSite"}'
   when 2 then concat('{"@type":"Restaurant","openingHours":["Mo-Fr ', lpad(cast(7+page_id%4 as string),2,'0'), ':00-20:00"]}')
   when 3 then '{"@graph":[{"openingHoursSpecification":[{"dayOfWeek":["https://schema.org/Monday","Tuesday"],"opens":"9:00","closes":"00:00"}]}]}'
   else '{"openingHoursSpecification":{"dayOfWeek":"Sa","opens":"10:00","closes":"10:00"}}' end, '</script>') as html from @pages
"""

PROJECTIONS["fx_query_points"] = """
select event_id as query_id, 40e0 + ((p*7919)%7000)/1e4 + 5/111320e0 as lat, -42e-1 + ((p*104729)%12000)/1e4 as lng, ts as at_time
 from (select *, event_id%7500 as p from @events)
"""

PROJECTIONS["fx_viewports"] = """
select n_nationkey as view_id, lat+5e-2 as north, lat-5e-2 as south, lng+5e-2 as east, lng-5e-2 as west, 1e-2 as cell
 from (select n_nationkey, 40e0 + ((n_nationkey*311*7919)%7000)/1e4 as lat, -42e-1 + ((n_nationkey*311*104729)%12000)/1e4 as lng from (select cast(n_nationkey as bigint) as n_nationkey from @nation))
"""

PROJECTIONS["fx_madrid_rows"] = """
select cast(l_orderkey as string) as id_local, concat('LOCAL ', cast(l_orderkey%97 as string)) as rotulo, split_part('1,1,1,0,12', ',', cast(l_orderkey%5+1 as int)) as id_tipo_acceso_local,
 split_part('1,1,1,1,4,8', ',', cast(l_orderkey%6+1 as int)) as id_situacion_local, 'Abierto' as desc_situacion_local,
 case when l_orderkey%41=0 then 'N/D' else cast(420000+(l_orderkey*97)%60000 as string) end as coordenada_x_local, cast(4455000+(l_orderkey*89)%45000 as string) as coordenada_y_local,
 code as id_epigrafe, case when l_partkey%23=0 then '' else concat('DESC ', code) end as desc_epigrafe
 from (select *, split_part('471103,471101,471104,472911,472502,472907,472908,472909,472501,561001,561002,561004,561005,999999,869001,960201,', ',', cast(l_partkey%17+1 as int)) as code from @lineitem)
"""

PROJECTIONS["fx_store_sites"] = """
select p_partkey as id, case when p_partkey%11=0 then 'https://www.facebook.com/x' when p_partkey%3=0 then concat('https://www.', replace(p_name,' ','-'), '.es/') else concat('https://local', cast(p_partkey as string), '.example.com/carta') end as website,
 (p_partkey%4=0) as has_osm_hours, (p_partkey%6=0) as checked_recently from @part
"""

PROJECTIONS["fx_robots"] = "\nunion all\n".join(
    f"select concat('https://local', cast(n_nationkey*100+1 as string), '.example.com') as origin,"
    f" {number} as line_no, '{line}' as line from @nation"
    for number, line in enumerate(
        ("User-agent: badbot", "Disallow: /", "User-agent: *", "Disallow: /carta # menu", "Disallow:"), 1
    )
)

PROJECTIONS["fx_ip_ranges"] = """
select 167772160+cast(n_nationkey as bigint)*10 as lo, 167772160+cast(n_nationkey as bigint)*10+(case when n_nationkey%6=5 then 4 else 9 end) as hi, 30e0+n_nationkey*6e-1 as lat, -9e0+n_nationkey*5e-1 as lng, case when n_nationkey%4<>0 then n_name end as city_es, n_name as city_en from @nation
"""

PROJECTIONS["fx_import_runs"] = """
select o_orderkey as id, split_part('osm,censo_madrid,censo_barcelona,censo_diba,censo_andalucia', ',', cast(o_custkey%5+1 as int)) as source_name, case when o_orderkey%900=0 then 'failed' else 'succeeded' end as status, md5(cast(o_custkey%7 as string)) as file_hash, o_orderdate as started_at from @orders
"""

# The stored table of places: canonical rows, hidden evidence rows and some fixture rows, with
# match evidence on part of the canonical rows. Badges are comma-joined text here.
PROJECTIONS["fx_places"] = """
select o.id, 'osm' as source_name, o.source_local_id, o.name, o.name as normalized_name,
 case when o.id%4=0 then '' when o.id%4=1 then concat('Via ', cast(o.id as string)) end as address,
 case when o.id%29=0 then 'Distrito viejo' end as district, cast(null as string) as neighbourhood,
 o.lat, o.lng, o.place_type, (o.place_type='bar') as sells_onsite_beer,
 (o.place_type not in ('bar','otro')) as sells_takeaway_beer,
 o.opening_hours_osm, o.opening_hours_web,
 case when o.id%5=0 then concat('https://local', cast(o.id%4000 as string), '.example.com/carta') end as website,
 case when o.id%19=0 then 'posible_cerrado' when c.id is not null or o.id%23=0 then 'bar,oficial' else '' end as badge_list,
 case when o.id%3=0 then 80 else 55 end as confidence_score, o.confidence_level, 'osm-v1' as scoring_version,
 o.is_chain, case when o.id%31=0 then 'Abierto' end as official_status, o.is_published,
 case when o.confidence_level='excluded' then 'osm_missing_latest_extract' end as publication_reason,
 o.last_seen_osm_at, cast((o.id%11)*100 as bigint) as last_import_run_id,
 c.source_name as matched_censo_source, c.source_local_id as matched_censo_local_id,
 case when c.id is not null then 'censo-match-v2-high-precision' end as censo_match_version,
 case when c.id is not null then (case when c.id%41=0 then 'guess' else 'exact_name' end) end as censo_match_method,
 case when c.id is not null then (case when c.id%43=0 then 31e0 else 5e0 end) end as censo_match_distance_m,
 case when c.id is not null then 1e0 end as censo_match_name_similarity
 from (@fx_osm) o left join (select * from (@fx_censo) where id%3<>0) c on o.id=(c.id-1000000)*10
union all
select id, case when id%50=1 then 'madrid_sample_fixture' else source_name end, source_local_id, name, name,
 case when id%7=0 then '' else address end, concat('Distrito ', cast(id%9 as string)), concat('Barrio ', cast(id%13 as string)),
 lat, lng, place_type, (place_type='bar'), (place_type not in ('bar','otro')), cast(null as string), cast(null as string),
 cast(null as string), case when id%37=0 then 'posible_cerrado' else concat(place_type, ',horario_no_confirmado') end,
 90, case when id%8=0 then 'excluded' else 'high' end, 'censo-v1', (id%12=0), official_status, false, 'censo_only_unconfirmed',
 null, cast((id%14)*100 as bigint), cast(null as string), cast(null as string), cast(null as string),
 cast(null as string), cast(null as double), cast(null as double)
 from (@fx_censo)
"""

# Raw register rows and map features in their sources' own columns.
PROJECTIONS["fx_bcn_rows"] = """
select case when c_custkey%5=4 then concat('new-', cast(c_custkey as string)) else cast(c_custkey as string) end as ID_Global,
 split_part('1400001,1400002,1400003,1400000,1000020,1001000,1000030,1000000,9999999,', ',', cast(c_custkey%10+1 as int)) as Codi_Activitat_2022,
 concat('Activitat ', cast(c_custkey%10 as string)) as Nom_Activitat,
 case when c_custkey%7=0 then 'SN' when c_custkey%7=1 then ' ' when c_custkey%7=2 then concat('Mercadona ', c_name) else concat('Bar Núria ', cast(c_custkey as string)) end as Nom_Local,
 case when c_custkey%4=0 then 'Si' else 'No' end as SN_Obert24h, case when c_custkey%6=0 then 'Si' else 'No' end as SN_Servei_Degustacio,
 case when c_custkey%31=0 then 'x' when c_custkey%29=0 then '43.5' else concat('41.', lpad(cast(2000+(c_custkey*37)%3000 as string),4,'0'), case when c_custkey%3=0 then ' N' else '' end) end as Latitud,
 case when c_custkey%23=0 then '' else concat('2.', lpad(cast((c_custkey*53)%3000 as string),4,'0')) end as Longitud,
 case when c_custkey%11=0 then ' ' else concat(' Carrer ', cast(c_custkey%40 as string)) end as Nom_Via,
 cast(c_custkey%90 as string) as Num_Policia_Inicial, case when c_custkey%8=0 then 'B' else '' end as Lletra_Inicial,
 case when c_custkey%2=0 then cast(c_custkey%90+2*(c_custkey%3) as string) else '' end as Num_Policia_Final, '' as Lletra_Final,
 concat('Barri ', cast(c_custkey%12 as string)) as Nom_Barri, case when c_custkey%9=0 then '' else concat('Districte ', cast(c_custkey%9 as string)) end as Nom_Districte
 from @customer
"""

PROJECTIONS["fx_diba_rows"] = """
select cast(820000000+c_nationkey as string) as codi_ens,
 case c_nationkey%4 when 0 then 'Ajuntament de Sant Celoni' when 1 then 'Ajuntament d''Abrera' when 2 then 'AJUNTAMENT DE  Vic' else ' Consell Comarcal ' end as nom_ens,
 cast(c_custkey as string) as identificador,
 split_part('Restaurant bar|Barberia|Supermercat|Venda de vins i begudes|Elaboració de vins|Comerç d''alimentació i begudes|Forn de pa|Carnisseria-xarcuteria|Establiments de menjar ràpid|Productes alimentaris diversos|Oficina|Cafè', '|', cast(c_custkey%12+1 as int)) as descripcio_activitat,
 case when c_custkey%5=0 then '' when c_custkey%5=1 then concat('Lidl, ', c_name) else concat('Els Avets ', cast(c_custkey as string)) end as nom_comercial,
 concat(' Carrer Major ', cast(c_custkey%99 as string)) as adreca_complerta, 'C' as sector_economic,
 case when c_custkey%17=0 then '39.9' else concat('41.', lpad(cast((c_custkey*37)%10000 as string),4,'0')) end as latitud,
 case when c_custkey%19=0 then '' else concat('2.', lpad(cast((c_custkey*53)%10000 as string),4,'0')) end as longitud
 from @customer
"""

PROJECTIONS["fx_andalucia_rows"] = """
select cast(3000000+s_suppkey as string) as id, case when s_suppkey%4=0 then ' ' when s_suppkey%4=1 then concat('CARREFOUR ', s_name) else concat(s_name, ' SL') end as razon_social,
 case when s_suppkey%6=0 then '' else concat('AV KANSAS ', cast(s_suppkey as string)) end as domicilio, '41007' as codpos, 'Sevilla' as provincia, '41091' as codmun,
 case when s_suppkey%5=0 then ' ' else concat(' Municipio ', cast(s_nationkey as string)) end as nombre_mun,
 split_part('5630,5610,4711, 4725 ,4721,4722,4723,4724,4729,4730,9999', ',', cast(s_suppkey%11+1 as int)) as cnae,
 concat('Actividad ', cast(s_suppkey%11 as string)) as actividad, 'G' as sector_actividad,
 case when s_suppkey%13<>0 then -7e0 + ((s_suppkey*37)%500)/1e2 end as lng, case when s_suppkey%13<>0 then (case when s_suppkey%10=0 then 41e0 else 36e0 + ((s_suppkey*53)%290)/1e2 end) end as lat
 from @supplier
"""

PROJECTIONS["fx_osm_features"] = """
select concat(split_part('n,w,a,r', ',', cast(o_orderkey%4+1 as int)), cast(o_orderkey as string)) as id,
 split_part('bar,pub,cafe,restaurant,fast_food,fuel,bench,', ',', cast(o_orderkey%8+1 as int)) as amenity,
 split_part('convenience,alcohol,supermarket,general,kiosk,clothes,,,', ',', cast(o_orderkey%9+1 as int)) as shop,
 case when o_orderkey%3=0 then split_part('24/7|Mo-Su 09:00-22:00||Mo-Fr 08:00-15:00; PH off', '|', cast(o_orderkey%4+1 as int)) end as opening_hours,
 case when o_orderkey%10<>0 then concat(' Bar Á', cast(o_orderkey%1000 as string), ' · Niño') end as name,
 case when o_orderkey%4=0 then concat('Calle ', cast(o_orderkey%50 as string)) end as street, case when o_orderkey%6=0 then cast(o_orderkey%80 as string) end as housenumber,
 case o_orderkey%14 when 0 then 'www.Foo.es' when 1 then 'HTTPS://Bar.COM/Menu?x=1' when 2 then 'ftp://a.b' when 3 then 'no dot' when 4 then 'localhost' when 5 then concat('http://local', cast(o_orderkey%40 as string), '.example.com') when 6 then ' https://x.example.org?q=1 ' end as website,
 case when o_orderkey%9=0 then 'contact.example.com/carta' end as contact_website,
 case when o_orderkey%13=0 then 'DIA' end as brand, case when o_orderkey%26=1 then 'Q1' end as brand_wikidata,
 case when o_orderkey%7=0 then 'yes' end as automated, case when o_orderkey%11=0 then 'yes' end as self_service,
 cast(400000+(o_orderkey*7919)%7000 as bigint) as lat4, cast(42000-(o_orderkey*104729)%12000 as bigint) as lng4
 from @orders
"""

# Inputs of the current scorer.
PROJECTIONS["fx_score_input"] = """
select o_orderkey as id,
 concat_ws(' ', split_part('BAR|CERVECERÍA|24 HORAS|BODEGA|MINI MARKET|PANADERIA|LOCAL|DIA|TIENDA 24H|VINOS Y BARBERIA', '|', cast(o_orderkey%10+1 as int)), split_part('PACO|LOLA||SOL', '|', cast(o_orderkey%4+1 as int))) as name,
 split_part('471103,471101,471104,472911,472502,472907,472908,472909,472501,561001,561002,561004,561005,999999,,', ',', cast(o_orderkey%16+1 as int)) as code1,
 split_part('471103,472502,561001,999999,,,', ',', cast(o_orderkey%7+1 as int)) as code2,
 split_part('Abierto,Baja,,cerrado,Abierto,Abierto,Uso  Vivienda,Abierto,Abierto,Abierto,Abierto', ',', cast(o_orderkey%11+1 as int)) as status,
 case when o_orderkey%5=0 then '24/7' when o_orderkey%5=1 then ' Mo-Fr 10:00-20:00' when o_orderkey%5=2 then ' ' end as hours,
 case when o_orderkey%3=0 then split_part('bar,Pub,cafe,restaurant,fast_food,bench', ',', cast(o_orderkey%6+1 as int)) end as amenity,
 case when o_orderkey%9=1 then split_part('alcohol,wine,supermarket,convenience,kiosk,clothes', ',', cast(o_orderkey%6+1 as int)) end as shop
 from @orders
"""

# Shared pieces of oracle text, DuckDB only; filled by the query catalogue.
ORACLE_PARTS: dict[str, str] = {}

_REFERENCE = re.compile(r"@([a-z][a-z0-9_]*)")


def _expand(sql: str, parts: dict[str, str]) -> str:
    """Replace `@name` for the names in `parts` until none is left; other text stays."""
    while True:
        out = _REFERENCE.sub(lambda m: parts.get(m.group(1), m.group(0)).strip(), sql)
        if out == sql:
            return out
        sql = out


def oracle_text(sql: str) -> str:
    """The DuckDB form: projections inlined, base tables by name."""
    return _expand(sql, {**{t: t for t in BASE_TABLES}, **PROJECTIONS, **ORACLE_PARTS})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table of the test data."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def projection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A place-shaped projection of the base tables."""
    files = {t: f"parquet.`{folder}/{t}.parquet`" for t in BASE_TABLES}
    return spark.sql(_expand(PROJECTIONS[name], {**files, **PROJECTIONS}))

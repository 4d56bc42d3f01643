"""Classification and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import (
    CHAINS, sql_activity, sql_chain, sql_closed, sql_fold, sql_in_box, sql_level, sql_list, sql_map, sql_name, _LEADING,
)
from barrio.functions import classify as c
from barrio.functions.text import with_chain_flag
from barrio.plans import ingest
from barrio.sources.scans import scan_chain_patterns


def chain_table(d: Data):
    """The pattern table with its seeds, one of them switched off."""
    rows = ", ".join(f"('{p}', '{p.title()}', {p != 'BAR'})" for p in [*CHAINS, "BAR"])
    return d.spark.sql(f"select * from values {rows} as t(pattern, label, enabled)")


def patterns(d: Data):
    return scan_chain_patterns(chain_table(d))


def _hit(e: str, words: list[str]) -> str:
    return f"regexp_matches({e}, '{'|'.join(words)}')"


part(
    "score_base",
    "select *, (code1 in ({bars}) or code2 in ({bars})) as bar_code, (code1 in ({food}) or code2 in ({food})) as food_code, "
    "(code1 = '471103' or code2 = '471103') as store_code, (code1 = '472502' or code2 = '472502') as drink_code, "
    "{hb} as hb, {h24} as h24, {hbo} as hbo, {hs} as hs, {nb} as nb from (select id, {fold} as n, code1, code2, {closed} as closed, {chain} as chain, "
    "trim(coalesce(hours, '')) as h, lower(trim(coalesce(amenity, ''))) as am, lower(trim(coalesce(shop, ''))) as sh, name from (@fx_score_input))".format(
        bars=sql_list(c.BAR_CODES), food=sql_list(c.FOOD_CODES), hb=_hit("n", c.HINT_BAR), h24=_hit("n", c.HINT_24H),
        hbo=_hit("n", c.HINT_BODEGA), hs=_hit("n", c.HINT_SHOP), nb=_hit("n", c.HINT_NOT_BAR), fold=sql_fold("name"),
        closed=sql_closed("status"), chain=sql_chain(sql_fold("name"), CHAINS),
    ),
)
part(
    "score_typed",
    "select *, case when am in ('bar', 'pub') then 'bar' when sh in ('alcohol', 'wine') then 'bodega' when sh = 'supermarket' then 'supermercado' "
    "when bar_code then 'bar' when am in ('cafe', 'restaurant') and not nb then 'bar' when chain then 'supermercado' when store_code or h24 then 'tienda_24h' "
    "when drink_code or hbo then 'bodega' when food_code or hs then 'alimentacion' else 'otro' end as t from (@score_base)",
)
part(
    "score_points",
    "select *, greatest(0, least(100, " + sql_map(c.BASE_SCORE, "t") + " + case when h <> '' then 15 else 0 end + case when h = '24/7' then 10 else 0 end "
    "+ case when hb then 5 else 0 end + case when h24 then 5 else 0 end + case when hbo then 5 else 0 end + case when hs then 5 else 0 end "
    "+ case when sh in ('convenience', 'alcohol', 'supermarket') then 5 else 0 end + case when am in ('bar', 'pub') then 5 else 0 end "
    "- case when t = 'otro' and not (hb or h24 or hbo or hs or sh <> '' or am <> '') then 100 else 0 end)) as s, "
    f"(t in ({sql_list(c.TAKEAWAY_TYPES)}) or hbo or hs or contains(n, 'CERVEZA') or sh in ({sql_list(c.OSM_TAKEAWAY_SHOPS)})) as take, "
    f"(t = 'bar' or (am in ({sql_list(c.OSM_AMENITIES)}) and not nb)) as onsite from (@score_typed)",
)


@query(
    "c1_score_v2",
    "select id, case when closed then 'otro' else t end as place_type, take and not closed as sells_takeaway_beer, onsite and not closed as sells_onsite_beer, "
    "cast(case when closed then 0 else s end as integer) as confidence_score, case when closed then 'excluded' else " + sql_level("s") + " end as confidence_level, "
    "case when closed then 'posible_cerrado,horario_no_confirmado' else concat_ws(',', case when t <> 'otro' then t end, case when take then 'vende_cerveza_para_llevar' end, "
    "case when onsite then 'vende_cerveza_in_situ' end, case when h = '' then 'horario_no_confirmado' end) end as badges, 'v2-beer' as scoring_version, chain as is_chain from (@score_points)",
)
def _(d: Data):
    rows = with_chain_flag(d.fx_score_input, "name", patterns(d))
    codes = F.filter(F.array("code1", "code2"), lambda x: x != "")
    inputs = map(F.col, ("status", "hours", "amenity", "shop", "is_chain"))
    scored = c.with_score_v2(rows, F.col("name"), codes, *inputs)
    return scored.select("id", *ingest.CLASS_FIELDS, "is_chain").withColumn("badges", F.array_join("badges", ","))


_V1 = sorted(c.CODE_SCORE_V1)


@query(
    "c2_score_v1",
    "select id, cat as primary_category, cast(case when closed then 0 else s end as integer) as confidence_score, case when closed or chain then 'excluded' else " + sql_level("s") + " end as confidence_level, "
    "case when closed then 'posible_cerrado,horario_no_confirmado' else concat_ws(',', case when cat in ('alimentacion', 'ultramarinos') then 'alimentacion' end, "
    "case when cat = 'conveniencia' or code1 = '471103' or code2 = '471103' then 'conveniencia' end, case when cat = 'bodega' then 'bodega' end, "
    "case when cat = 'snacks' or code1 in ('472907','472908','472909') or code2 in ('472907','472908','472909') then 'snacks' end, "
    "case when code1 in ('472502','472501') or code2 in ('472502','472501') or contains(n, 'BEBIDAS') then 'bebidas' end, case when h24 then '24h' end, 'horario_no_confirmado') end as badges, "
    "'v1-deterministic' as scoring_version from (select *, greatest(0, least(100, b + case when " + _hit("n", c.HINT_STRONG_V1) + " then 20 else 0 end + case when " + _hit("n", c.HINT_ADJACENT_V1) + " then 10 else 0 end "
    "- case when chain then 80 else 0 end - case when b = 0 then 50 else 0 end)) as s, case when contains(n, 'ULTRAMARINOS') then 'ultramarinos' when b = 0 then 'otro' else "
    + sql_map(c.CODE_CATEGORY_V1, "best", "'otro'") + " end as cat from (select *, greatest(b1, b2) as b, case when b1 >= b2 then code1 else code2 end as best from (select * exclude (closed), "
    + sql_closed("status0", c.CLOSED_WORDS_V1) + " as closed, "
    + sql_map(c.CODE_SCORE_V1, "code1", "0") + " as b1, " + sql_map(c.CODE_SCORE_V1, "code2", "0") + " as b2 from (@score_base) join (select id as id0, status as status0 from (@fx_score_input)) on id = id0)))",
)
def _(d: Data):
    rows = with_chain_flag(d.fx_score_input, "name", patterns(d))
    codes = F.filter(F.array("code1", "code2"), lambda x: x != "")
    scored = c.with_score_v1(rows, F.col("name"), codes, F.col("status"), F.col("is_chain"))
    fields = ["primary_category", "confidence_score", "confidence_level", "badges", "scoring_version"]
    return scored.select("id", *fields).withColumn("badges", F.array_join("badges", ","))


SQL_OSM_TYPE = (
    f"case when amenity in ({sql_list(c.OSM_AMENITIES)}) then 'bar' when amenity = 'fuel' then 'gasolinera' when shop = 'supermarket' then 'supermercado' "
    "when shop = 'alcohol' then 'bodega' when shop = 'convenience' and contains(coalesce(opening_hours, ''), '24/7') then 'tienda_24h' "
    "when shop in ('convenience', 'general', 'kiosk') then 'alimentacion' else 'otro' end"
)
SQL_OSM_KEEP = (
    f"(amenity in ({sql_list(c.OSM_AMENITIES)}) or shop in ({sql_list(c.OSM_SHOPS)}) or (amenity = 'fuel' and opening_hours is not null "
    "and coalesce(automated, '') <> 'yes' and coalesce(self_service, '') <> 'yes'))"
)


@query(
    "c3_classify_osm",
    f"select id, t as place_type, t = 'bar' as sells_onsite_beer, t not in ('bar', 'otro') as sells_takeaway_beer from (select id, {SQL_OSM_TYPE} as t from (@fx_osm_features))",
)
def _(d: Data):
    kind = c.classify_osm(F.col("amenity"), F.col("shop"), F.col("opening_hours"))
    return d.fx_osm_features.select("id", kind.alias("k")).select("id", "k.*")


def tag_map(df):
    """The tags map of a flat feature projection; absent tags have no entry."""
    keys = {
        "amenity": "amenity", "shop": "shop", "opening_hours": "opening_hours", "name": "name",
        "addr:street": "street", "addr:housenumber": "housenumber", "website": "website",
        "contact:website": "contact_website", "brand": "brand", "brand:wikidata": "brand_wikidata",
        "automated": "automated", "self_service": "self_service",
    }
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in keys.items()])
    return df.withColumn("tags", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))


@query("c4_osm_keep", f"select id, amenity, shop from (@fx_osm_features) where {SQL_OSM_KEEP}")
def _(d: Data):
    return tag_map(d.fx_osm_features).where(c.osm_keep(F.col("tags"))).select("id", "amenity", "shop")


@query(
    "c5_osm_score",
    "select id, cast(case when coalesce(opening_hours, '') <> '' then 80 else 55 end as integer) as confidence_score, "
    "case when coalesce(opening_hours, '') <> '' then 'high' else 'medium' end as confidence_level, "
    "coalesce(brand, '') <> '' or coalesce(brand_wikidata, '') <> '' as is_chain from (@fx_osm_features)",
)
def _(d: Data):
    s = c.osm_score(F.col("opening_hours"), F.col("brand"), F.col("brand_wikidata"))
    return d.fx_osm_features.select("id", s.alias("s")).select("id", "s.*")


def sql_census(rows: str) -> str:
    """Score, level and badges from t, onsite columns."""
    score = sql_map(c.BASE_SCORE, "t")
    return (
        f"select *, cast({score} as integer) as confidence_score, {sql_level('(' + score + ')')} as confidence_level, t <> 'bar' as takeaway, "
        "concat_ws(',', t, case when t <> 'bar' then 'vende_cerveza_para_llevar' end, case when onsite then 'vende_cerveza_in_situ' end, 'horario_no_confirmado') as badges "
        f"from ({rows}) where t is not null"
    )


_DIBA_WORDS = "string_split(a, ' ')"
SQL_DIBA_TYPE = (
    f"case when list_has_any({_DIBA_WORDS}, [{sql_list(c.DIBA_BAR)}]) or {_hit('a', c.DIBA_BAR_TEXT)} then 'bar' "
    f"when list_has_any({_DIBA_WORDS}, [{sql_list(c.DIBA_SUPER)}]) then 'supermercado' "
    f"when list_has_any({_DIBA_WORDS}, [{sql_list(c.DIBA_DRINKS)}]) and not {_hit('a', c.DIBA_DRINKS_VETO)} then 'bodega' "
    f"when list_has_any({_DIBA_WORDS}, [{sql_list(c.DIBA_FOOD)}]) or {_hit('a', c.DIBA_FOOD_TEXT)} then 'alimentacion' end"
)
_CLASS_OUT = "t as place_type, onsite as sells_onsite_beer, takeaway as sells_takeaway_beer, confidence_score, confidence_level, badges"

part(
    "bcn_class",
    sql_census(
        "select *, (t = 'bar' or SN_Servei_Degustacio = 'Si') as onsite from (select *, case when SN_Obert24h = 'Si' and m <> 'bar' then 'tienda_24h' else m end as t from (select *, "
        + sql_map(c.BCN_TYPES, "Codi_Activitat_2022") + f" as m, {sql_chain(sql_fold('Nom_Local'), CHAINS)} as is_chain, {_LEADING.format('Latitud')} as lat, {_LEADING.format('Longitud')} as lng from (@fx_bcn_rows)))"
    ),
)
part(
    "diba_class",
    sql_census(
        f"select *, t = 'bar' as onsite from (select *, {SQL_DIBA_TYPE} as t from (select *, {sql_activity('descripcio_activitat')} as a, {sql_chain(sql_fold('nom_comercial'), CHAINS)} as is_chain, "
        f"{_LEADING.format('latitud')} as lat, {_LEADING.format('longitud')} as lng from (@fx_diba_rows)))"
    ),
)
part(
    "andalucia_class",
    sql_census(
        "select *, t = 'bar' as onsite from (select *, " + sql_map(c.CNAE_TYPES, "trim(cnae)") + f" as t, {sql_chain(sql_fold('razon_social'), CHAINS)} as is_chain from (@fx_andalucia_rows))"
    ),
)

_NAME_BCN = "case when trim(Nom_Local) in ('', 'SN') then trim(Nom_Activitat) else trim(Nom_Local) end"
_NAME_DIBA = "coalesce(nullif(trim(nom_comercial), ''), trim(descripcio_activitat))"
_NAME_AND = "coalesce(nullif(trim(razon_social), ''), trim(actividad))"


def _batch_sql(source: str, ident: str, name: str, box: str) -> str:
    return (
        f"select {ident} as source_local_id, {name} as name, {sql_name(name)} as normalized_name, {_CLASS_OUT}, is_chain "
        f"from (@{source}_class) where {sql_in_box(box)}"
    )


def _batch(df):
    return df.select(
        "source_local_id", "name", "normalized_name", "place_type", "sells_onsite_beer", "sells_takeaway_beer",
        "confidence_score", "confidence_level", F.array_join("badges", ",").alias("badges"), "is_chain",
    )


@query("c6_classify_bcn", _batch_sql("bcn", "ID_Global", _NAME_BCN, "barcelona"))
def _(d: Data):
    return _batch(ingest.barcelona_batch(d.fx_bcn_rows, patterns(d)))


@query("c7_classify_andalucia", _batch_sql("andalucia", "id", _NAME_AND, "andalucia"))
def _(d: Data):
    return _batch(ingest.andalucia_batch(d.fx_andalucia_rows, patterns(d)))


@query("c8_classify_diba", _batch_sql("diba", "concat(codi_ens, '-', identificador)", _NAME_DIBA, "diba"))
def _(d: Data):
    return _batch(ingest.diba_batch(d.fx_diba_rows, patterns(d)))


_CATEGORY = "split_part('conveniencia,alimentacion,ultramarinos,bodega,snacks,otro', ',', cast(o_orderkey%6+1 as int))"


@query(
    "c9_legacy_backfill",
    "select id, case when ch then 'supermercado' when cat = 'conveniencia' then 'tienda_24h' when cat in ('alimentacion', 'ultramarinos') then 'alimentacion' when cat = 'bodega' then 'bodega' else 'otro' end as place_type, "
    "ch or cat in ('conveniencia', 'alimentacion', 'ultramarinos', 'bodega') as sells_takeaway_beer, false as sells_onsite_beer from (select o_orderkey as id, o_orderkey%13=0 as ch, " + _CATEGORY + " as cat from @orders)",
)
def _(d: Data):
    k = c.legacy_place_type(F.col("o_orderkey") % 13 == 0, F.expr(_CATEGORY))
    return d.orders.select(F.col("o_orderkey").alias("id"), k.alias("k")).select("id", "k.*")


@query(
    "c10_target_code",
    f"select id_epigrafe as code, id_epigrafe in ({sql_list(c.TARGET_CODES)}) as is_target, count(*) as n from (@fx_madrid_rows) group by id_epigrafe",
)
def _(d: Data):
    return d.fx_madrid_rows.groupBy(F.col("id_epigrafe").alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("is_target", c.is_target_code(F.col("code")))


@query(
    "j9_code_lookups",
    "select 'bcn' as source, t as place_type, count(*) as n from (@bcn_class) group by 2 union all select 'andalucia', t, count(*) from (@andalucia_class) group by 2",
)
def _(d: Data):
    """Code tables of fixed size act as expressions: rows of other codes drop out as in a join."""
    yes = lambda x: F.col(x) == "Si"
    bcn = c.classify_bcn(F.col("Codi_Activitat_2022"), yes("SN_Obert24h"), yes("SN_Servei_Degustacio"))
    rows = d.fx_bcn_rows.select(F.lit("bcn").alias("source"), bcn["place_type"].alias("place_type")).union(
        d.fx_andalucia_rows.select(F.lit("andalucia"), c.classify_andalucia(F.col("cnae"))["place_type"])
    )
    return rows.where("place_type is not null").groupBy("source", "place_type").agg(F.count(F.lit(1)).alias("n"))

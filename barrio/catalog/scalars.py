"""Scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.functions import classify, fields, geo, links, text
from barrio.operators import hours, serve, traffic

# DuckDB counterparts of the name forms.
_PLAIN = "translate(strip_accents({0}), '^`¨¯´·¸', '')"
_FOLD = "upper(trim(regexp_replace(replace(" + _PLAIN + ", 'ß', 'ss'), '\\s+', ' ', 'g')))"
_NAME = "upper(trim(regexp_replace(regexp_replace(" + _PLAIN + ", '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')))"
_ACTIVITY = "upper(trim(regexp_replace(" + _PLAIN + ", '[^a-zA-Z0-9]+', ' ', 'g')))"


def sql_fold(e: str) -> str:
    return f"coalesce({_FOLD.format(e)}, '')"


def sql_name(e: str) -> str:
    return f"coalesce({_NAME.format(e)}, '')"


def sql_activity(e: str) -> str:
    return f"coalesce({_ACTIVITY.format(e)}, '')"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_dice(a: str, b: str) -> str:
    ta, tb = (f"list_distinct(list_filter(string_split({e}, ' '), lambda t: t <> ''))" for e in (a, b))
    return (
        f"case when {a} = '' and {b} = '' then 0e0 when {a} = {b} then 1e0 when len({ta}) = 0 or len({tb}) = 0 then 0e0 "
        f"else 2e0 * len(list_intersect({ta}, {tb})) / (len({ta}) + len({tb})) end"
    )


def sql_generic(e: str) -> str:
    n = f"upper(trim({e}))"
    words = f"list_filter(string_split({n}, ' '), lambda t: t <> '')"
    return (
        f"({n} <> '' and ({n} in ({sql_list(text.GENERIC_NAMES)}) or (len({words}) > 0 and "
        f"len(list_filter({words}, lambda t: t not in ({sql_list(text.GENERIC_TOKENS)}))) = 0)))"
    )


def sql_compatible(a: str, b: str) -> str:
    shops = sql_list(classify.TAKEAWAY_TYPES)
    return f"({a} = {b} or ({a} in ({shops}) and {b} in ({shops})))"


def sql_closed(e: str, words=classify.CLOSED_WORDS) -> str:
    return f"regexp_matches({sql_fold(e)}, '{'|'.join(words)}')"


def sql_chain(folded: str, patterns: list[str]) -> str:
    return f"regexp_matches({folded}, '(^|[^A-Za-z0-9_])({'|'.join(patterns)})($|[^A-Za-z0-9_])')"


def sql_level(e: str) -> str:
    return f"case when {e} >= 80 then 'high' when {e} >= 55 then 'medium' when {e} >= 30 then 'low' else 'excluded' end"


def sql_map(values: dict, e: str, other: str = "null") -> str:
    cases = " ".join(f"when {sql_list([k])} then {sql_list([v]) if isinstance(v, str) else v}" for k, v in values.items())
    return f"case {e} {cases} else {other} end"


def sql_distance(a: str, b: str, c: str, d: str) -> str:
    """Local ellipsoidal metres between (a, b) and (c, d), as lat, lng."""
    mid = f"radians(({a} + {c}) / 2e0)"
    w = f"(1e0 - 0.0066943799901413165e0 * sin({mid}) * sin({mid}))"
    m = f"(6378137e0 * (1e0 - 0.0066943799901413165e0) / ({w} * sqrt({w})))"
    n = f"(6378137e0 / sqrt({w}))"
    dy, dx = f"({m} * radians({c} - {a}))", f"({n} * cos({mid}) * radians({d} - {b}))"
    return f"sqrt({dy} * {dy} + {dx} * {dx})"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    hl, hg = f"sin(radians({c} - {a}) / 2e0)", f"sin(radians({d} - {b}) / 2e0)"
    return f"12742e0 * asin(sqrt({hl} * {hl} + cos(radians({a})) * cos(radians({c})) * {hg} * {hg}))"


def sql_host(e: str) -> str:
    return f"regexp_replace(lower(nullif(regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '')), '^www\\.', '')"


CHAINS = [
    "MERCADONA", "CARREFOUR", "DIA", "LIDL", "ALDI", "ALCAMPO", "AHORRAMAS", "SUPERCOR",
    "EL CORTE INGLES", "EROSKI",
]


@query(
    "n1_fold_upper",
    f"select doc_id, md5({sql_fold('text')}) as folded_md5 from @documents",
)
def _(d: Data):
    return d.documents.select("doc_id", F.md5(text.fold_upper(F.col("text"))).alias("folded_md5"))


@query("n2_match_name", f"select doc_id, md5({sql_name('text')}) as name_md5 from @documents")
def _(d: Data):
    return d.documents.select("doc_id", F.md5(text.match_name(F.col("text"))).alias("name_md5"))


@query("n3_activity_text", f"select doc_id, md5({sql_activity('text')}) as activity_md5 from @documents")
def _(d: Data):
    return d.documents.select("doc_id", F.md5(text.activity_text(F.col("text"))).alias("activity_md5"))


part(
    "same_spot",
    "select o.id as osm_id, c.id as censo_id, o.name as osm_name, c.name as censo_name, o.place_type as osm_type, "
    "c.place_type as censo_type from (@fx_osm) o join (@fx_censo) c on o.id = (c.id - 1000000) * 10",
)


def _same_spot(d: Data):
    o, c = d.fx_osm, d.fx_censo
    return o.join(c, o.id == (c.id - 1000000) * 10).select(
        o.id.alias("osm_id"), c.id.alias("censo_id"), o.name.alias("osm_name"), c.name.alias("censo_name"),
        o.place_type.alias("osm_type"), c.place_type.alias("censo_type"),
    )


@query(
    "n4_dice_tokens",
    f"select osm_id, round({sql_dice('osm_name', 'censo_name')}, 6) as similarity from (@same_spot)",
)
def _(d: Data):
    return _same_spot(d).select(
        "osm_id", F.round(text.dice_tokens(F.col("osm_name"), F.col("censo_name")), 6).alias("similarity")
    )


_LABELLED = (
    "select id, case id%3 when 0 then name when 1 then split_part(name, ' ', 1) "
    "else concat(split_part(name, ' ', 1), ' DE BAR') end as label from (@fx_osm)"
)


@query("n5_is_generic_name", f"select id, {sql_generic('label')} as generic from ({_LABELLED})")
def _(d: Data):
    first = F.split_part("name", F.lit(" "), F.lit(1))
    label = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, first).otherwise(
        F.concat(first, F.lit(" DE BAR"))
    )
    return d.fx_osm.select("id", text.is_generic_name(label).alias("generic"))


@query(
    "n6_types_compatible",
    f"select osm_id, censo_id, {sql_compatible('osm_type', 'censo_type')} as compatible from (@same_spot)",
)
def _(d: Data):
    return _same_spot(d).select(
        "osm_id", "censo_id", classify.types_compatible(F.col("osm_type"), F.col("censo_type")).alias("compatible")
    )


_SHOP_NAME = (
    "concat(case p_partkey%6 when 0 then 'Súper Día ' when 1 then 'Diario ' when 2 then 'El Corte Inglés-' "
    "when 3 then 'media_lidl ' when 4 then 'LIDL,' else '' end, p_name)"
)


@query(
    "n7_chain_flag",
    f"select p_partkey as id, {sql_chain(sql_fold(_SHOP_NAME), CHAINS)} as is_chain from @part",
)
def _(d: Data):
    named = d.part.select(F.col("p_partkey").alias("id"), F.expr(_SHOP_NAME).alias("name"))
    patterns = d.spark.sql(f"select explode(array({sql_list(CHAINS)})) as pattern")
    return text.with_chain_flag(named, "name", patterns).select("id", "is_chain")


_STATUS = "split_part('Abierto|Baja|cerrado temporal|Inactivo|Uso   vivienda|Ánulado|', '|', cast(o_orderkey%7+1 as int))"


@query("n8_officially_closed", f"select o_orderkey as id, {sql_closed(_STATUS)} as closed from @orders")
def _(d: Data):
    return d.orders.select(
        F.col("o_orderkey").alias("id"), classify.officially_closed(F.expr(_STATUS)).alias("closed")
    )


@query(
    "n9_level_from_score",
    "select id, cast(s as bigint) as score, " + sql_level("s") + " as level from (select id, greatest(0, least(100, raw)) as s "
    "from (select o_orderkey as id, o_orderkey%160-30 as raw from @orders))",
)
def _(d: Data):
    score = classify.clamp_score(F.col("o_orderkey") % 160 - 30)
    return d.orders.select(
        F.col("o_orderkey").alias("id"), score.cast("bigint").alias("score"),
        classify.level_from_score(score).alias("level"),
    )


_NUMERIC = "case when regexp_matches({0}, '^-?[0-9]+(\\.[0-9]+)?$') then try_cast({0} as double) end"


@query(
    "n10_numeric_or_null",
    "select distinct id_local, " + _NUMERIC.format("coordenada_x_local") + " as x, "
    + _NUMERIC.format("concat('-', coordenada_y_local, '.5')") + " as y_signed, "
    + _NUMERIC.format("concat('+', coordenada_y_local)") + " as y_plus from (@fx_madrid_rows)",
)
def _(d: Data):
    y = F.col("coordenada_y_local")
    return d.fx_madrid_rows.select(
        "id_local",
        text.numeric_or_null(F.col("coordenada_x_local")).alias("x"),
        text.numeric_or_null(F.concat(F.lit("-"), y, F.lit(".5"))).alias("y_signed"),
        text.numeric_or_null(F.concat(F.lit("+"), y)).alias("y_plus"),
    ).distinct()


def sql_utm(rows: str) -> str:
    """The Krüger series with its coefficients computed in SQL."""
    f = "(1e0 / 298.257223563e0)"
    n = f"({f} / (2e0 - {f}))"
    k = f"(0.9996e0 * 6378137e0 / (1e0 + {n}) * (1e0 + {n}*{n}/4 + {n}*{n}*{n}*{n}/64))"
    return f"""
select id_local, -3e0 + degrees(atan2(sinh(eta), cos(xi))) as lng,
 degrees(chi + (2*n - 2*n*n/3 - 2*n*n*n)*sin(2*chi) + (7*n*n/3 - 8*n*n*n/5)*sin(4*chi) + (56*n*n*n/15)*sin(6*chi)) as lat
from (select *, asin(sin(xi)/cosh(eta)) as chi from (select id_local, n,
  a - (n/2 - 2*n*n/3 + 37*n*n*n/96)*sin(2*a)*cosh(2*b) - (n*n/48 + n*n*n/15)*sin(4*a)*cosh(4*b) - (17*n*n*n/480)*sin(6*a)*cosh(6*b) as xi,
  b - (n/2 - 2*n*n/3 + 37*n*n*n/96)*cos(2*a)*sinh(2*b) - (n*n/48 + n*n*n/15)*cos(4*a)*sinh(4*b) - (17*n*n*n/480)*cos(6*a)*sinh(6*b) as eta
 from (select id_local, {n} as n, y/{k} as a, (x - 500000e0)/{k} as b from ({rows}))))"""


@query(
    "n11_utm30_to_wgs84",
    "select id_local, round(lng, 6) as lng, round(lat, 6) as lat from ("
    + sql_utm(
        "select distinct id_local, try_cast(coordenada_x_local as double) as x, cast(coordenada_y_local as double) as y "
        "from (@fx_madrid_rows)"
    )
    + ")",
)
def _(d: Data):
    rows = d.fx_madrid_rows.select(
        "id_local", F.col("coordenada_x_local").try_cast("double").alias("x"),
        F.col("coordenada_y_local").try_cast("double").alias("y"),
    ).distinct()
    lng, lat = geo.utm30_to_wgs84(F.col("x"), F.col("y"))
    return rows.select("id_local", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


_SHAPE = (
    "case o_orderkey%4 when 0 then concat('[-', cast(o_orderkey%9 as string), '.5, 40.', cast(o_orderkey%8 as string), ']') "
    "when 1 then concat('[[[-3.5,', cast(o_orderkey%60 as string), '],[-2, ', cast(o_orderkey%50 as string), '.25],[-3.5,41]]]') "
    "when 2 then concat('[-3,40,', cast(o_orderkey as string), ']') else '[]' end"
)


@query(
    "n12_geometry_mean_point",
    "select id, case when n > 0 then round(list_sum(xs)/n, 6) end as lng, case when n > 0 then round(list_sum(ys)/n, 6) end as lat from ("
    "select id, len(ps) as n, list_transform(ps, lambda p: cast(regexp_extract(p, '\\[\\s*([-0-9.]+)', 1) as double)) as xs, "
    "list_transform(ps, lambda p: cast(regexp_extract(p, ',\\s*([-0-9.]+)', 1) as double)) as ys from ("
    "select o_orderkey as id, regexp_extract_all(" + _SHAPE + ", '\\[\\s*-?[0-9.]+\\s*,\\s*-?[0-9.]+\\s*\\]') as ps from @orders))",
)
def _(d: Data):
    lng, lat = geo.geometry_mean_point(F.expr(_SHAPE))
    return d.orders.select(F.col("o_orderkey").alias("id"), F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


@query(
    "n13_osm_address",
    "select id, nullif(trim(concat_ws(' ', nullif(street, ''), nullif(housenumber, ''))), '') as address from (@fx_osm_features)",
)
def _(d: Data):
    return d.fx_osm_features.select(
        "id", fields.osm_address(F.col("street"), F.col("housenumber")).alias("address")
    )


part(
    "website_urls",
    "select id, case when raw <> '' and length(raw) <= 500 and not regexp_matches(raw, '\\s') and regexp_matches(u, '^(?i)https?://[^/?#\\s]+') "
    "and contains(h, '.') then concat(lower(regexp_extract(u, '^([A-Za-z]+)://', 1)), '://', h, case when starts_with(r, '/') then '' else '/' end, r) end as website "
    "from (select *, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#\\s]+)', 1)) as h, regexp_extract(u, '^[A-Za-z]+://[^/?#\\s]+(.*)$', 1) as r "
    "from (select id, raw, case when regexp_matches(raw, '^(?i)[a-z][a-z0-9+.-]*:') then raw else concat('https://', raw) end as u "
    "from (select id, trim(coalesce(website, contact_website, '')) as raw from (@fx_osm_features))))",
)


@query("n14_website_url", "@website_urls")
def _(d: Data):
    return d.fx_osm_features.select(
        "id", fields.website_url(F.col("website"), F.col("contact_website")).alias("website")
    )


# Odd links built from an id, and what must come of each: link, canonical form, path.
ODD_LINKS = [
    ("HTTPS://Foo{}.ES:443/a/../b", "https://foo{}.es/b", "/b"),
    ("http://x{}.es:8080\\c\\.", "http://x{}.es:8080/c/", "/c/"),
    ("https://u{}.es/ú{{x}}|y?q=ñ", "https://u{}.es/%C3%BA%7Bx%7D|y?q=%C3%B1", "/%C3%BA%7Bx%7D|y"),
    ("bare{}.es#", "https://bare{}.es/#", "/"),
    ("http://up{}.es/%2e%2E/./z/..", "http://up{}.es/", "/"),
    ("https://wide{}.es:99999/", None, None),
    ("https://bad|{}.es/", None, None),
]


def _pieces(template: str) -> list[str]:
    return template.replace("{{", "{").replace("}}", "}").split("{}")


def _sql_odd(which: int) -> str:
    arms = []
    for i, row in enumerate(ODD_LINKS):
        if row[which] is not None:
            text = " || page_id || ".join(f"'{p}'" for p in _pieces(row[which]))
            arms.append(f"when page_id % {len(ODD_LINKS)} = {i} then {text}")
    return "case " + " ".join(arms) + " end"


@query(
    "n14_canonical_links",
    f"select page_id as id, {_sql_odd(1)} as website, {_sql_odd(2)} as path, "
    "regexp_extract(website, '^[a-z]+://([^/:]+)', 1) as host from @pages where website is not null "
    "union all select page_id, null, null, null from @pages where " + _sql_odd(1) + " is null",
)
def _(d: Data):
    made = [
        F.concat(*[x for p in _pieces(row[0]) for x in (F.lit(p), F.col("page_id").cast("string"))][:-1]) for row in ODD_LINKS
    ]
    raw = F.get(F.array(*made), (F.col("page_id") % len(ODD_LINKS)).cast("int"))
    website = fields.website_url(raw, F.lit(None).cast("string"))
    rows = d.pages.select(F.col("page_id").alias("id"), website.alias("website"))
    return rows.select("id", "website", links.url_path(F.col("website")).alias("path"), links.url_host(F.col("website")).alias("host"))


_MADRID_PARTS = {
    "class": "case when c_custkey%3=0 then '' else 'CALLE' end",
    "road": "concat('DE ', c_mktsegment)",
    "number": "case when c_custkey%4=0 then null else cast(c_custkey as string) end",
    "qualifier": "case when c_custkey%5=0 then 'B' else '' end",
}


@query(
    "n15_madrid_address",
    "select c_custkey as id, trim(concat_ws(' ', " + ", ".join(f"nullif({e}, '')" for e in _MADRID_PARTS.values()) + ")) as address from @customer",
)
def _(d: Data):
    return d.customer.select(
        F.col("c_custkey").alias("id"),
        fields.madrid_address(*[F.expr(e) for e in _MADRID_PARTS.values()]).alias("address"),
    )


@query(
    "n16_bcn_address",
    "select ID_Global, case when via <> '' then concat_ws(' ', via, nullif(case when a <> '' and b <> '' and a <> b then concat(a, '-', b) else a end, '')) end as address "
    "from (select ID_Global, trim(Nom_Via) as via, trim(concat(Num_Policia_Inicial, Lletra_Inicial)) as a, trim(concat(Num_Policia_Final, Lletra_Final)) as b from (@fx_bcn_rows))",
)
def _(d: Data):
    cols = ("Nom_Via", "Num_Policia_Inicial", "Lletra_Inicial", "Num_Policia_Final", "Lletra_Final")
    return d.fx_bcn_rows.select("ID_Global", fields.bcn_address(*map(F.col, cols)).alias("address"))


@query(
    "n17_display_name",
    "select 'bcn' as source, ID_Global as id, case when trim(Nom_Local) in ('', 'SN') then trim(Nom_Activitat) else trim(Nom_Local) end as name from (@fx_bcn_rows) "
    "union all select 'diba', identificador, coalesce(nullif(trim(nom_comercial), ''), trim(descripcio_activitat), '') from (@fx_diba_rows) "
    "union all select 'andalucia', id, coalesce(nullif(trim(razon_social), ''), trim(actividad), '') from (@fx_andalucia_rows)",
)
def _(d: Data):
    name = fields.display_name
    bcn = d.fx_bcn_rows.select(
        F.lit("bcn").alias("source"), F.col("ID_Global").alias("id"),
        name(F.col("Nom_Local"), F.col("Nom_Activitat"), "SN").alias("name"),
    )
    diba = d.fx_diba_rows.select(
        F.lit("diba"), "identificador", name(F.col("nom_comercial"), F.col("descripcio_activitat"))
    )
    south = d.fx_andalucia_rows.select(
        F.lit("andalucia"), "id", name(F.col("razon_social"), F.col("actividad"))
    )
    return bcn.union(diba).union(south)


@query(
    "n18_municipality",
    "select identificador as id, nullif(trim(regexp_replace(trim(nom_ens), '^(?i)Ajuntament\\s+(de\\s+|d'')', '')), '') as municipality from (@fx_diba_rows)",
)
def _(d: Data):
    return d.fx_diba_rows.select(
        F.col("identificador").alias("id"), fields.municipality(F.col("nom_ens")).alias("municipality")
    )


def sql_in_box(name: str, lat: str = "lat", lng: str = "lng") -> str:
    b = geo.BOXES[name]
    return (
        f"coalesce({lat} between {b['lat'][0]}e0 and {b['lat'][1]}e0 and {lng} between {b['lng'][0]}e0 and {b['lng'][1]}e0, false)"
    )


_LEADING = "try_cast(nullif(regexp_extract(trim({0}), '^([+-]?[0-9]+\\.?[0-9]*)', 1), '') as double)"


@query(
    "n19_bbox_guards",
    "select 'barcelona' as source, count(*) as n, cast(count_if(not ok) as bigint) as skipped from (select "
    + sql_in_box("barcelona", _LEADING.format("Latitud"), _LEADING.format("Longitud")) + " as ok from (@fx_bcn_rows)) "
    "union all select 'diba', count(*), cast(count_if(not ok) as bigint) from (select "
    + sql_in_box("diba", _LEADING.format("latitud"), _LEADING.format("longitud")) + " as ok from (@fx_diba_rows)) "
    "union all select 'andalucia', count(*), cast(count_if(not ok) as bigint) from (select " + sql_in_box("andalucia") + " as ok from (@fx_andalucia_rows)) "
    "union all select 'madrid', count(*), cast(count_if(not ok) as bigint) from (select coalesce(try_cast(coordenada_x_local as double) between 420000 and 470000 "
    "and try_cast(coordenada_y_local as double) between 4460000 and 4495000, false) as ok from (@fx_madrid_rows)) "
    "union all select 'spain', count(*), cast(count_if(not ok) as bigint) from (select " + sql_in_box("spain") + " as ok from (@fx_ip_ranges))",
)
def _(d: Data):
    def guard(df, source, ok):
        return df.agg(
            F.lit(source).alias("source"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("skipped")
        )

    lead, num = text.leading_number, text.numeric_or_null
    box = lambda name, lat, lng: geo.in_box(lat, lng, geo.BOXES[name])
    parts = [
        guard(d.fx_bcn_rows, "barcelona", box("barcelona", lead(F.col("Latitud")), lead(F.col("Longitud")))),
        guard(d.fx_diba_rows, "diba", box("diba", lead(F.col("latitud")), lead(F.col("longitud")))),
        guard(d.fx_andalucia_rows, "andalucia", box("andalucia", F.col("lat"), F.col("lng"))),
        guard(d.fx_madrid_rows, "madrid", geo.in_madrid_utm(num(F.col("coordenada_x_local")), num(F.col("coordenada_y_local")))),
        guard(d.fx_ip_ranges, "spain", box("spain", F.col("lat"), F.col("lng"))),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.union(one)
    return out


@query(
    "n20_badge_algebra",
    "select id, array_to_string(b, ',') as badges, array_to_string(list_filter(b, lambda x: x <> 'oficial'), ',') as without_official, "
    "array_to_string(case when list_contains(b, 'posible_cerrado') then b else list_append(b, 'posible_cerrado') end, ',') as closed_once, "
    "list_contains(b, 'bar') as has_bar from (select id, list_filter(string_split(badge_list, ','), lambda x: x <> '') as b from (@fx_places))",
)
def _(d: Data):
    b = F.col("badges")
    mark = F.lit("posible_cerrado")
    once = F.when(F.array_contains(b, mark), b).otherwise(F.array_append(b, mark))
    return d.stores.select(
        "id", F.array_join(b, ",").alias("badges"),
        F.array_join(F.array_remove(b, "oficial"), ",").alias("without_official"),
        F.array_join(once, ",").alias("closed_once"), F.array_contains(b, "bar").alias("has_bar"),
    )


@query(
    "n21_url_host",
    f"select page_id as id, {sql_host('url')} as host from @pages union all select id + 10000000, {sql_host('website')} from (@fx_store_sites)",
)
def _(d: Data):
    host = lambda c: links.url_host(F.col(c)).alias("host")
    return d.pages.select(F.col("page_id").alias("id"), host("url")).union(
        d.fx_store_sites.select(F.col("id") + 10000000, host("website"))
    )


def sql_parameter(key: str) -> str:
    return f"try_cast(list_extract(regexp_extract_all(uri, '[?&]{key}=(-?[0-9]+\\.?[0-9]*)', 1), -1) as double)"


part(
    "log_points",
    "select event_id, ts, remote_ip, case when near and lat is not null and lng is not null then lat when boxed then (n + s) / 2 end as lat, "
    "case when near and lat is not null and lng is not null then lng when boxed then (e + w) / 2 end as lng from (select event_id, ts, remote_ip, "
    "contains(uri, '/api/stores/nearby') as near, (contains(uri, '/api/stores/map') or contains(uri, '/api/stores/clusters')) as boxed, "
    + ", ".join(f"{sql_parameter(k)} as {a}" for k, a in (("lat", "lat"), ("lng", "lng"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w")))
    + " from (@fx_access_log))",
)


@query("n22_log_coordinate", "select event_id, round(lat, 6) as lat, round(lng, 6) as lng from (@log_points) where lat is not null")
def _(d: Data):
    at = traffic.located_requests(d.fx_access_log.select("event_id", "uri"))
    return at.select("event_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    "n23_log_day_visitor",
    "select event_id, case event_id%3 when 2 then '?' else strftime(ts, '%Y-%m-%d') end as day, "
    "case event_id%4 when 3 then '?' else remote_ip end as ip from (@fx_access_log)",
)
def _(d: Data):
    kind, who = F.col("event_id") % 3, F.col("event_id") % 4
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    epoch = F.when(kind == 0, seconds.cast("double"))
    iso = F.when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    pick = lambda n: F.when(who == n, F.col("remote_ip")).otherwise("")
    return d.fx_access_log.select(
        "event_id", traffic.log_day(epoch, iso).alias("day"),
        traffic.visitor(pick(0), pick(1), pick(2)).alias("ip"),
    )


@query(
    "n24_haversine_km",
    f"select id, round({sql_haversine('lat', 'lng', '40.4168e0', '(-3.7038e0)')}, 6) as km from (@fx_osm)",
)
def _(d: Data):
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(40.4168), F.lit(-3.7038))
    return d.fx_osm.select("id", F.round(km, 6).alias("km"))


SQL_VERIFICATION = (
    "case when {0}source_name = 'osm' and {0}matched_censo_source is not null then 'verified' "
    "when {0}source_name = 'osm' then 'mapped' else 'unverified' end"
)


@query(
    "n25_verification",
    f"select v as verification, count(*) as n, min(id) as first_id from (select id, {SQL_VERIFICATION.format('')} as v from (@fx_places)) group by v",
)
def _(d: Data):
    v = serve.verification(F.col("source_name"), F.col("matched_censo_source"))
    return d.stores.groupBy(v.alias("verification")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )


part(
    "filled",
    "select s.id, coalesce(nullif(s.address, ''), nullif(c.address, '')) as address, coalesce(s.district, c.district) as district, "
    "coalesce(s.neighbourhood, c.neighbourhood) as neighbourhood, s.matched_censo_source is not null as matched, c.address is not null as found "
    "from (@fx_places) s left join (select * from (@fx_places) where source_name like 'censo%') c "
    "on c.source_name = s.matched_censo_source and c.source_local_id = s.matched_censo_local_id",
)


@query("n26_address_fallback", "select id, address, district, neighbourhood from (@filled)")
def _(d: Data):
    return serve.with_evidence(d.stores, d.stores).select("id", "address", "district", "neighbourhood")


@query(
    "n27_marker_labels",
    "select id, intent, label, case when intent = 'barra' then concat(label, ' · En barra') when intent = 'lata' then concat(label, ' · En lata') else label end as subtitle, "
    f"case when v = 'unverified' then '{serve.UNVERIFIED_NOTE}' end as note, "
    "concat('https://www.google.com/maps/dir/?api=1&destination=', cast(id%90 as string), ',', cast(id%180 as string)) as link, "
    "case when src = 'none' then 'unconfirmed' when sells and src = 'estimated' then 'estimated' when sells then 'open' when o then 'ordinance' else 'closed' end as state from ("
    "select id, case when sells_onsite_beer then 'barra' when sells_takeaway_beer then 'lata' else 'otro' end as intent, "
    + sql_map(serve.TYPE_LABEL, "place_type", "'Local'") + f" as label, {SQL_VERIFICATION.format('')} as v, "
    "case id%4 when 0 then 'none' when 1 then 'estimated' else 'osm' end as src, id%3=0 as sells, id%5=0 as o from (@fx_places))",
)
def _(d: Data):
    blocked = F.when(F.col("id") % 5 == 0, hours.REASONS["ordinance"]).otherwise(hours.REASONS["closed"])
    source = F.when(F.col("id") % 4 == 0, "none").when(F.col("id") % 4 == 1, "estimated").otherwise("osm")
    block = F.struct(
        F.lit(True).alias("open"), (F.col("id") % 3 == 0).alias("sells_beer_now"),
        blocked.alias("reason"), source.alias("hours_source"),
    )
    intent = serve.intent_of(F.col("sells_onsite_beer"), F.col("sells_takeaway_beer"))
    v = serve.verification(F.col("source_name"), F.col("matched_censo_source"))
    rows = d.stores.withColumn("intent", intent).withColumn("_b", block)
    return rows.select(
        "id", "intent", serve.type_label(F.col("place_type")).alias("label"),
        serve.subtitle(F.col("place_type"), F.col("intent")).alias("subtitle"),
        serve.unverified_note(v).alias("note"),
        serve.directions_link(F.col("id") % 90, F.col("id") % 180).alias("link"),
        serve.state_of(F.col("_b")).alias("state"),
    )


@query(
    "n28_serving_filters",
    "select id, place_type from (@fx_places) where is_published and confidence_level <> 'excluded' and sells_takeaway_beer "
    "and place_type in ('bodega', 'tienda_24h', 'gasolinera') and not is_chain and confidence_level = 'medium'",
)
def _(d: Data):
    rows = serve.serving_filter(
        serve.served(d.stores), "para_llevar", ["bodega", "tienda_24h", "gasolinera"], True, "medium"
    )
    return rows.select("id", "place_type")


_PARAMETERS = {
    "lat": "cast(event_id%100 as double)", "lng": "cast(event_id%370-180 as double)",
    "radius_m": "case when event_id%3=0 then null else event_id%6000 end",
    "limit": "case when event_id%5=0 then null else event_id%210 end",
    "at_time_text": "case event_id%4 when 0 then '2026-06-03T10:00:00' when 1 then 'soon' when 2 then ' ' end",
}


@query(
    "n29_parameter_check",
    "select query_id, radius_m, lim as limit_rows, concat_ws(',', case when not lat between -90 and 90 then 'lat' end, case when not lng between -180 and 180 then 'lng' end, "
    "case when not radius_m between 1 and 5000 then 'radius_m' end, case when not lim between 1 and 200 then 'limit' end, "
    "case when at_time_text = 'soon' then 'at_time' end) as rejected from (select query_id, lat, lng, coalesce(radius_m, 1000) as radius_m, coalesce(lim, 50) as lim, at_time_text from ("
    "select event_id as query_id, " + ", ".join(f"{e} as {'lim' if n == 'limit' else n}" for n, e in _PARAMETERS.items()) + " from @events))",
)
def _(d: Data):
    asked = d.events.select(
        F.col("event_id").alias("query_id"), *[F.expr(e).alias(n) for n, e in _PARAMETERS.items()]
    )
    return serve.check_parameters(asked).select(
        "query_id", F.col("radius_m").cast("bigint").alias("radius_m"),
        F.col("limit").cast("bigint").alias("limit_rows"), "rejected",
    )

"""Source round trips (S1 to S10): a projection is written in the source's format and scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrio.catalog.classes import chain_table, tag_map
from barrio.catalog.registry import Data, query
from barrio.catalog.scalars import CHAINS, sql_list
from barrio.operators import traffic
from barrio.session import new_path, spread
from barrio.sources import scans

_MADRID = [
    "id_local", "rotulo", "id_tipo_acceso_local", "id_situacion_local", "desc_situacion_local",
    "coordenada_x_local", "coordenada_y_local", "id_epigrafe", "desc_epigrafe",
]


def _as_csv(df: DataFrame, columns: list[str], sep: str, label: str) -> str:
    have = set(df.columns)
    path = new_path(df.sparkSession, label)
    full = df.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in columns])
    full.write.csv(
        path, sep=sep, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def _nullified(columns: list[str]) -> str:
    return ", ".join(f"nullif({c}, '') as {c}" for c in columns)


@query("s1_madrid_csv", f"select {_nullified(_MADRID)} from (@fx_madrid_rows)")
def _(d: Data):
    path = _as_csv(d.fx_madrid_rows, scans.MADRID_COLUMNS, ";", "madrid")
    return scans.scan_madrid(d.spark, path).select(*_MADRID)


@query("s2_barcelona_csv", f"select {_nullified(scans.BCN_COLUMNS)} from (@fx_bcn_rows)")
def _(d: Data):
    return scans.scan_barcelona(d.spark, _as_csv(d.fx_bcn_rows, scans.BCN_COLUMNS, ",", "bcn"))


@query("s3_diba_csv", f"select {_nullified(scans.DIBA_COLUMNS)} from (@fx_diba_rows)")
def _(d: Data):
    return scans.scan_diba(d.spark, _as_csv(d.fx_diba_rows, scans.DIBA_COLUMNS, ",", "diba"))


def _one_document_per_chunk(items: DataFrame, chunk, document, label: str) -> str:
    """Write rows as JSON documents of a thousand items, one document per file."""
    path = new_path(items.sparkSession, label)
    docs = items.groupBy(chunk.alias("chunk")).agg(F.to_json(document).alias("value"))
    docs.write.partitionBy("chunk").text(path)
    return path


@query("s4_andalucia_geojson", "select " + ", ".join(scans.ANDALUCIA_PROPERTIES) + ", lng, lat from (@fx_andalucia_rows)")
def _(d: Data):
    geometry = F.when(
        F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    )
    feature = F.struct(geometry.alias("geometry"), F.struct(*scans.ANDALUCIA_PROPERTIES).alias("properties"))
    document = F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
    chunk = F.floor(F.col("id").cast("bigint") / 1000)
    path = _one_document_per_chunk(d.fx_andalucia_rows, chunk, document, "andalucia")
    return scans.scan_andalucia(d.spark, path)


@query(
    "s5_osm_sequence",
    "select id, round((-lng4 / 1e4) + 0.5e0, 6) as lng, round(lat4 / 1e4, 6) as lat, amenity, opening_hours, name from (@fx_osm_features)",
)
def _(d: Data):
    """A record separator before each line, a square around the point, and bad lines between."""
    corner = lambda dx, dy: F.array(-F.col("lng4") / 1e4 + F.lit(dx), F.col("lat4") / 1e4 + F.lit(dy))
    ring = F.array(F.array(corner(0.0, -0.5), corner(1.0, -0.5), corner(1.0, 0.5), corner(0.0, 0.5)))
    feature = F.struct(
        "id", F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
        F.col("tags").alias("properties"),
    )
    text = F.concat(F.lit("\x1e"), F.to_json(feature))
    lines = tag_map(spread(d.fx_osm_features)).select(F.explode(F.array(text, F.lit(""), F.lit("{oops"))).alias("value"))
    path = new_path(d.spark, "osm")
    lines.write.text(path)
    places = scans.osm_places(scans.scan_osm_features(d.spark, path))
    return places.select(
        F.col("source_local_id").alias("id"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"),
        "amenity", F.col("opening_hours"), "name",
    )


@query(
    "s6_overpass_json",
    "select concat('node/', cast(n as varchar)) as id, lat4 / 1e4 as lat, lng4 / 1e4 as lng, amenity, shop from (select *, cast(substr(id, 2) as bigint) as n from (@fx_osm_features)) "
    "where (coalesce(amenity, '') <> '' or coalesce(shop, '') <> '') and n % 5 <> 4",
)
def _(d: Data):
    number = F.substring("id", 2, 20).cast("bigint")
    lat, lng = F.col("lat4") / 1e4, F.col("lng4") / 1e4
    own, centre = number % 5 < 2, number % 5 < 4
    element = F.struct(
        F.lit("node").alias("type"), number.alias("id"),
        F.when(own, lat).alias("lat"), F.when(own, lng).alias("lon"),
        F.when(centre, F.struct(lat.alias("lat"), lng.alias("lon"))).alias("center"), "tags",
    )
    path = _one_document_per_chunk(
        tag_map(d.fx_osm_features), F.floor(number / 1000), F.struct(F.collect_list(element).alias("elements")), "overpass"
    )
    places = scans.osm_places(scans.scan_overpass(d.spark, path))
    return places.select(F.col("source_local_id").alias("id"), "lat", "lng", "amenity", "shop")


@query(
    "s7_sample_csv",
    "select c_custkey::varchar as source_local_id, trim(c_name) as name, c_custkey * 1.5e0 as x, 4460000e0 + c_custkey as y from @customer",
)
def _(d: Data):
    rows = d.customer.select(
        F.col("c_custkey").cast("string").alias("source_local_id"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"),
        (F.col("c_custkey") * F.lit(1.5)).cast("string").alias("x_25830"),
        (F.col("c_custkey") + 4460000).cast("string").alias("y_25830"),
    )
    path = _as_csv(rows, scans.SAMPLE_COLUMNS, ",", "sample")
    return scans.scan_sample(d.spark, path).select("source_local_id", "name", "x", "y")


@query(
    "s8_access_log",
    "select uri, remote_ip as ip, case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%d') else '?' end as day, count(*) as n from (@fx_access_log) group by 1, 2, 3",
)
def _(d: Data):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    stamp = F.when(F.col("event_id") % 2 == 0, seconds)
    entry = F.to_json(F.struct(stamp.alias("ts"), F.struct("uri", "remote_ip").alias("request")))
    lines = d.fx_access_log.select(F.explode(F.array(entry, F.lit("not json"), F.lit("{}"))).alias("value"))
    path = new_path(d.spark, "log")
    lines.write.option("compression", "gzip").text(path)
    log = scans.scan_access_log(d.spark, path, "part-*")
    day = traffic.log_day(F.col("ts_epoch"), F.col("ts_text"))
    who = traffic.visitor(F.col("remote_ip"), F.col("client_ip"), F.col("remote_addr"))
    return log.groupBy("uri", who.alias("ip"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s9_chain_patterns",
    f"select p as pattern, count(*) as n from (select p_partkey, unnest([{sql_list(CHAINS)}]) as p from @part) where p_partkey % 7 = length(p) % 7 group by 1",
)
def _(d: Data):
    """How many parts fall to each enabled pattern."""
    patterns = scans.scan_chain_patterns(chain_table(d)).withColumn("_k", F.length("pattern") % 7)
    parts = d.part.select((F.col("p_partkey") % 7).cast("int").alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    return patterns.join(parts, "_k").select("pattern", "n")


@query("s10_fingerprints")
def _(d: Data):
    return scans.fingerprints(d.spark, f"{d.folder}/*.parquet")

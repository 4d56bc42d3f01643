"""Access-log and crawl-planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_haversine, sql_host, sql_in_box, sql_list
from barrio.operators import crawl, traffic
from barrio.session import new_path
from barrio.sources.sinks import append_rows

part(
    "metros",
    " union all ".join(
        f"select {i} as ord, '{name}' as name, {lat}e0 as mlat, {lng}e0 as mlng" for i, (name, lat, lng) in enumerate(traffic.METROS)
    ),
)
part(
    "log_areas",
    "select event_id, ts, remote_ip, coalesce(arg_min(name, km * 100 - ord / 1e9) filter (km <= 45), 'Otras zonas') as area from (select p.event_id, p.ts, p.remote_ip, m.ord, m.name, "
    + sql_haversine("p.lat", "p.lng", "m.mlat", "m.mlng") + " as km from (@log_points) p cross join (@metros) m where p.lat is not null) group by 1, 2, 3",
)
part("triples", "select distinct strftime(ts, '%Y-%m-%d') as day, remote_ip as ip, area from (@log_areas)")


def _log(d: Data):
    return d.fx_access_log.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("remote_ip").alias("ip"), "uri"
    )


@query("j7_nearest_metro", "select event_id, area from (@log_areas)")
def _(d: Data):
    return traffic.with_metro(traffic.located_requests(_log(d))).select("event_id", "area")


@query(
    "g9_top_areas",
    "select area, visitors, round(visitors / (sum(visitors) over ()), 6) as share from (select area, count(distinct ip) as visitors from (@triples) group by area)",
)
def _(d: Data):
    return traffic.top_areas(traffic.searches(_log(d))).withColumn("share", F.round("share", 6))


@query(
    "g10_daily_activity",
    "select day, visitors, area as top_area, n as top_visitors from (select t.day, v.visitors, t.area, t.n, row_number() over (partition by t.day order by t.n desc, t.area) as r from "
    "(select day, area, count(*) as n from (@triples) group by 1, 2) t join (select day, count(distinct ip) as visitors from (@triples) group by 1) v on v.day = t.day) where r = 1 order by day desc limit 21",
)
def _(d: Data):
    return traffic.daily_activity(traffic.searches(_log(d)))


@query("g11_monthly_archive", "select substr(day, 1, 7) as month, area, count(distinct ip) as visitors from (@triples) group by 1, 2")
def _(d: Data):
    path = new_path(d.spark, "areas")
    monthly = (
        traffic.searches(_log(d)).select(F.substring("day", 1, 7).alias("month"), "ip", "area").distinct()
        .groupBy("month", "area").agg(F.count(F.lit(1)).alias("visitors"))
    )
    append_rows(monthly, path, "month")
    return d.spark.read.schema("area string, visitors bigint, month string").parquet(path)


@query(
    "j10_ip_city",
    "select v.ip, r.lat, r.lng, coalesce(r.city_es, r.city_en) as city, case when r.lo is null then 'none' else 'ip' end as source from (select distinct ip, case when ip <> 'bad' then 167772160 + cast(split_part(ip, '.', 4) as bigint) end as n "
    "from (select case when event_id % 97 = 0 then 'bad' else remote_ip end as ip from (@fx_access_log))) v left join (select * from (@fx_ip_ranges) where " + sql_in_box("spain") + ") r on v.n between r.lo and r.hi",
)
def _(d: Data):
    ip = F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.col("remote_ip"))
    return traffic.locate_visitors(d.fx_access_log.select(ip.alias("ip")), d.fx_ip_ranges)


# Networks within networks, and the forms in which an event's address is written: S is a supplier, E the event.
_NETWORKS = (
    "select '2001:db8:' || {hex} || '::/48' as network, 40e0 as lat, -3e0 as lng, 'wide ' || s_suppkey as city from {t} "
    "union all select '2001:DB8:' || {hex} || ':1:0::/64', 41e0, 2e0, 'narrow ' || s_suppkey from {t} where s_suppkey % 2 = 1 "
    "union all select '2001:db8:' || {hex} || ':2::/64', 50e0, 2e0, 'abroad ' || s_suppkey from {t} "
    "union all select '10.' || s_suppkey % 200 || '.0.0/16', 37e0, -6e0, 'four ' || s_suppkey % 200 from {t} where s_suppkey < 200"
)
_CITY = (
    "case when e.form in (2, 3) then 'four ' || s when form = 4 then null when form = 0 and s % 2 = 1 then 'narrow ' || s "
    "when form = 5 then null else 'wide ' || s end"
)


@query(
    "j10_ip_prefix",
    "select ip, city, case when city is null then null when form in (2, 3) then 37e0 when city like 'narrow%' then 41e0 else 40e0 end as lat, "
    "case when city is null then 'none' else 'ip' end as source from (select *, " + _CITY + " as city from ("
    "select *, event_id % 6 as form, case event_id % 6 "
    "when 0 then '2001:db8:' || h || ':1::' || (event_id % 9999) when 1 then '2001:0DB8:' || h || ':0003:0:0:0:' || (event_id % 9999) "
    "when 2 then '10.' || s || '.' || (event_id % 250) || '.7' when 3 then '::ffff:10.' || s || '.7.' || (event_id % 250) "
    "when 4 then '2001:db8:' || h || ':2:' || (event_id % 9999) || '::1' else '2001:db8:' || h || '::' || (event_id % 9999) || '::1' end as ip "
    "from (select *, lower(to_hex(s)) as h from (select event_id, user_id % (select least(count(*), 200) from @supplier) as s from @events))) e) group by all",
)
def _(d: Data):
    few = d.supplier.agg(F.least(F.count(F.lit(1)), F.lit(200)).alias("n")).scalar()
    networks = d.supplier.sparkSession.sql(
        _NETWORKS.format(hex="lower(hex(s_suppkey))", t="{t}"), t=d.supplier
    ).withColumns({"city_es": F.lit(None).cast("string"), "city_en": F.col("city")})
    s, e, form = (F.col("user_id") % few).alias("s"), F.col("event_id"), F.col("event_id") % 6
    h, tail = F.lower(F.hex("s")), (e % 9999).cast("string")
    written = (
        F.when(form == 0, F.concat(F.lit("2001:db8:"), h, F.lit(":1::"), tail))
        .when(form == 1, F.concat(F.lit("2001:0DB8:"), h, F.lit(":0003:0:0:0:"), tail))
        .when(form == 2, F.concat(F.lit("10."), F.col("s"), F.lit("."), e % 250, F.lit(".7")))
        .when(form == 3, F.concat(F.lit("::ffff:10."), F.col("s"), F.lit(".7."), e % 250))
        .when(form == 4, F.concat(F.lit("2001:db8:"), h, F.lit(":2:"), tail, F.lit("::1")))
        .otherwise(F.concat(F.lit("2001:db8:"), h, F.lit("::"), tail, F.lit("::1")))
    )
    visits = d.events.select("event_id", s).select(written.alias("ip"))
    return traffic.locate_by_prefix(visits, networks).select("ip", "city", "lat", "source")


part(
    "robots_rules",
    "select origin, line_no, agent, dis as disallow from (select *, last_value(a ignore nulls) over (partition by origin order by line_no rows between unbounded preceding and current row) as agent from ("
    "select origin, line_no, nullif(lower(trim(regexp_extract(t, '^(?i)user-agent:\\s*(.+)$', 1))), '') as a, trim(regexp_extract(t, '^(?i)disallow:\\s*(.*)$', 1)) as dis from ("
    "select *, trim(regexp_replace(line, '#.*$', '')) as t from (@fx_robots)))) where a is null and dis <> ''",
)


@query("w8_robots_sections", "select origin, line_no, agent, disallow from (@robots_rules)")
def _(d: Data):
    return crawl.robots_sections(d.fx_robots)


_URLS = "select distinct website as url, regexp_extract(website, '^([a-z]+://[^/?#]+)', 1) as origin, coalesce(nullif(regexp_extract(website, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') as path from (@fx_store_sites)"


@query(
    "j11_robots_block",
    f"select url, path, not exists (select 1 from (@robots_rules) r where r.origin = u.origin and r.agent = '*' and starts_with(u.path, r.disallow)) as allowed from ({_URLS}) u",
)
def _(d: Data):
    rules = crawl.applicable_rules(crawl.robots_sections(d.fx_robots), "placebot")
    return crawl.robots_verdict(d.fx_store_sites.select(F.col("website").alias("url")), rules).select("url", "path", "allowed")


part(
    "url_groups",
    "select website, host, ids, n, case when n > 3 then 'brand' when host is null or host in (" + sql_list(crawl.SKIPPED_HOSTS) + ") then 'host' else 'queued' end as status from ("
    f"select website, {sql_host('website')} as host, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as ids from (@fx_store_sites) where not has_osm_hours and not checked_recently group by website)",
)


def _sites(d: Data):
    """Store sites as served rows, some checked ten days and others a year before the instant."""
    days = F.when(F.col("checked_recently"), "2026-05-24 10:00:00").when(F.col("id") % 5 == 0, "2025-06-03 10:00:00")
    return d.fx_store_sites.select(
        "id", "website", F.when(F.col("has_osm_hours"), "24/7").alias("opening_hours_osm"),
        days.cast("timestamp_ntz").alias("hours_web_checked_at"), F.lit(True).alias("is_published"),
        F.lit("high").alias("confidence_level"),
    )


NOW = "2026-06-03 10:00:00"


@query("g8_crawl_queue", "select website, host, case when status = 'queued' then ids end as ids, n, status from (@url_groups)")
def _(d: Data):
    groups = crawl.url_groups(crawl.due_for_crawl(_sites(d), F.lit(NOW).cast("timestamp_ntz")))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return groups.select("website", "host", ids.alias("ids"), "n", "status")

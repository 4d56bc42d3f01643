"""Opening-hours queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barrio.catalog.registry import Data, part, query
from barrio.catalog.scalars import sql_map
from barrio.operators import hours, jsonld

_DAYS = "['Mo','Tu','We','Th','Fr','Sa','Su']"

# The effective hours of every place.
part(
    "effective",
    "select *, coalesce(h_osm, h_web, usual) as hours, case when h_osm is not null then 'osm' when h_web is not null then 'website' "
    "when usual is not null then 'estimated' else 'none' end as hours_source from (select *, nullif(trim(opening_hours_osm), '') as h_osm, "
    "nullif(trim(opening_hours_web), '') as h_web, " + sql_map(hours.DEFAULT_HOURS, "place_type") + " as usual from (@fx_places))",
)
part("schedules", "select distinct hours as schedule from (@effective) where hours is not null")

_SELECTOR = "(?:(?:Mo|Tu|We|Th|Fr|Sa|Su)(?:-(?:Mo|Tu|We|Th|Fr|Sa|Su))?|PH|SH)"
_TIMES = "(?:24/7|off|closed|[0-9]{1,2}:[0-5][0-9]-[0-9]{1,2}:[0-5][0-9](?:,[0-9]{1,2}:[0-5][0-9]-[0-9]{1,2}:[0-5][0-9])*)"
_RULE = f"^(?:{_SELECTOR}(?:,{_SELECTOR})*(?: +|$))?{_TIMES}?$"

# Rules as rows, then the last rule per day, then spans on the week circle, merged as islands.
part(
    "rule_rows",
    "select schedule, i, rule, regexp_extract(rule, '^((?:Mo|Tu|We|Th|Fr|Sa|Su|PH|SH|,|-)*)', 1) as sel from (select schedule, generate_subscripts(rs, 1) as i, unnest(rs) as rule from ("
    f"select schedule, list_transform(string_split(schedule, ';'), lambda r: trim(r)) as rs from (@schedules)) where len(list_filter(rs, lambda r: not regexp_matches(r, '{_RULE}'))) = 0)",
)
part("parsed_schedules", "select distinct schedule from (@rule_rows)")
part(
    "rule_days",
    "select schedule, i, rule, unnest(range(0, 7)) as day from (@rule_rows) where sel = '' union all "
    f"select schedule, i, rule, (a + unnest(range(0, ((b - a + 7) % 7) + 1))) % 7 from (select schedule, i, rule, list_position({_DAYS}, split_part(item, '-', 1)) - 1 as a, "
    f"list_position({_DAYS}, case when contains(item, '-') then split_part(item, '-', 2) else item end) - 1 as b from (select schedule, i, rule, unnest(string_split(sel, ',')) as item from (@rule_rows) where sel <> '')) where a is not null",
)
part(
    "day_spans",
    "select schedule, day * 1440 + s as s, day * 1440 + case when e <= s then e + 1440 else e end as e from (select schedule, day, "
    "cast(regexp_extract(x, '^([0-9]+):', 1) as int) * 60 + cast(regexp_extract(x, '^[0-9]+:([0-9]+)', 1) as int) as s, "
    "cast(regexp_extract(x, '-([0-9]+):', 1) as int) * 60 + cast(regexp_extract(x, '-[0-9]+:([0-9]+)', 1) as int) as e from ("
    "select schedule, day, unnest(case when contains(rule, '24/7') then ['00:00-24:00'] else regexp_extract_all(rule, '[0-9]+:[0-9]+-[0-9]+:[0-9]+') end) as x from ("
    "select *, row_number() over (partition by schedule, day order by i desc) as r from (@rule_days)) where r = 1))",
)
part(
    "circle",
    "select schedule, s, least(e, 10080) as e from (@day_spans) union all select schedule, 0, e - 10080 from (@day_spans) where e > 10080",
)
part(
    "open_rows",
    "select schedule, cast(s as integer) as start_min, cast(e as integer) as end_min, cast(case when s = 0 and e = 10080 then null when e = 10080 and h is not null then h else e end as integer) as until_min from ("
    "select *, max(case when s = 0 then e end) over (partition by schedule) as h from (select schedule, min(s) as s, max(e) as e from ("
    "select *, sum(fresh) over (partition by schedule order by s, e rows unbounded preceding) as g from (select *, case when s <= max(e) over (partition by schedule order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from (@circle))) group by schedule, g))",
)
part(
    "local_instants",
    "select query_id, at_time, (isodow(l) - 1) * 1440 + hour(l) * 60 + minute(l) as week_min, hour(l) * 60 + minute(l) as day_min from ("
    "select query_id, at_time, at_time at time zone 'UTC' at time zone 'Europe/Madrid' as l from (@fx_query_points))",
)


def sql_verdict() -> str:
    """Reason text from p (place_type), take, src, o (open), ban."""
    r = {k: "'" + v + "'" for k, v in hours.REASONS.items()}

    def by_source(kind: str) -> str:
        return f"case when src = 'estimated' then {r[kind + '_estimated']} when src = 'website' then {r[kind + '_website']} else {r[kind]} end"

    return (
        f"case when src = 'none' then {r['unknown']} when not o and src = 'estimated' then {r['closed_estimated']} when not o then {r['closed']} "
        f"when p = 'bar' then {by_source('bar')} when not take then {r['no_takeaway']} when ban then {r['ordinance']} else {by_source('shop')} end"
    )


@query("o1_hours_precedence", "select id, hours, hours_source from (@effective)")
def _(d: Data):
    h, source = hours.effective_hours(F.col("opening_hours_osm"), F.col("opening_hours_web"), F.col("place_type"))
    return d.stores.select("id", h.alias("hours"), source.alias("hours_source"))


def _schedules(d: Data):
    h, _ = hours.effective_hours(F.col("opening_hours_osm"), F.col("opening_hours_web"), F.col("place_type"))
    return d.stores.select(h.alias("schedule"))


@query(
    "o2_compile_hours",
    "select s.schedule, p.schedule is not null as parsed, start_min, end_min, until_min from (@schedules) s left join (@parsed_schedules) p on p.schedule = s.schedule left join (@open_rows) o on o.schedule = s.schedule",
)
def _(d: Data):
    compiled = hours.compile_schedules(_schedules(d))
    return compiled.select("schedule", "parsed", F.explode_outer("open_spans").alias("i")).select(
        "schedule", "parsed", "i.*"
    )


part(
    "instant_pairs",
    "select *, (isodow(l) - 1) * 1440 + hour(l) * 60 + minute(l) as week_min, hour(l) * 60 + minute(l) as day_min from (select *, at_time at time zone 'UTC' at time zone 'Europe/Madrid' as l from ("
    "select id, place_type, sells_takeaway_beer, hours, hours_source, timestamp '2026-01-01 00:00:00' + to_minutes(cast(abs(id) * 7919 % 525600 as int)) as at_time from (@effective)))",
)
part(
    "instant_states",
    "select i.*, o.schedule is not null as is_open, case when o.until_min is not null then concat(lpad(cast((o.until_min % 1440) // 60 as varchar), 2, '0'), ':', lpad(cast(o.until_min % 60 as varchar), 2, '0')) end as closes_at "
    "from (@instant_pairs) i left join (@open_rows) o on o.schedule = i.hours and i.week_min >= o.start_min and i.week_min < o.end_min",
)


def _instant_pairs(d: Data):
    """Every place of every source at an instant of its own, spread over the minutes of a year."""
    minutes = (F.abs("id") * 7919 % 525600).cast("int")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return d.stores.withColumn("at_time", start + F.make_dt_interval(mins=minutes))


@query("o3_is_open_at", "select id, is_open, closes_at from (@instant_states)")
def _(d: Data):
    h, _ = hours.effective_hours(F.col("opening_hours_osm"), F.col("opening_hours_web"), F.col("place_type"))
    week = hours.minute_of_week(F.col("at_time")).alias("week")
    rows = _instant_pairs(d).select(week, "id", h.alias("hours"))
    rows = hours.attach_schedules(rows, "hours")
    is_open, closes = hours.open_state(F.col("open_spans"), F.col("week"))
    return rows.select("id", is_open.alias("is_open"), closes.alias("closes_at"))


@query(
    "o4_ordinance",
    "select event_id, hour(l) * 60 + minute(l) as minute_of_day, hour(l) >= 22 or hour(l) < 9 as prohibited from (select event_id, ts at time zone 'UTC' at time zone 'Europe/Madrid' as l from @events)",
)
def _(d: Data):
    return d.events.select(
        "event_id", hours.minute_of_day(F.col("ts")).cast("bigint").alias("minute_of_day"),
        hours.takeaway_prohibited(F.col("ts")).alias("prohibited"),
    )


@query(
    "o5_can_sell",
    "select id, o as open, case when o then closes_at end as closes_at, o and (p = 'bar' or (take and not ban)) as sells_beer_now, " + sql_verdict() + " as reason, src as hours_source "
    "from (select id, is_open as o, closes_at, place_type as p, sells_takeaway_beer as take, hours_source as src, day_min >= 1320 or day_min < 540 as ban from (@instant_states))",
)
def _(d: Data):
    return hours.with_open_now(_instant_pairs(d), "at_time").select("id", "open_now.*")


# The JSON-LD statements of the five page kinds; the pages' own markup holds none.
part(
    "page_specs",
    "select page_id, unnest([0,1,2,3,4]) as day, concat(lpad(cast(7+page_id%4 as varchar), 2, '0'), ':00') as opens, '20:00' as closes from (@fx_pages) where contains(html, '\"openingHours\":') "
    "union all select page_id, unnest([0,1]), '09:00', '00:00' from (@fx_pages) where contains(html, '\"dayOfWeek\":[\"https://schema.org/Monday\"')",
)


@query("o6_json_ld_hours", "select page_id, cast(day as integer) as day, opens, closes from (@page_specs)")
def _(d: Data):
    return jsonld.hours_specs(d.fx_pages)


part(
    "page_days",
    "select page_id, day, string_agg(x, ',' order by x) as intervals from (select distinct page_id, day, concat(opens, '-', case when closes = '00:00' then '24:00' else closes end) as x from (@page_specs)) group by 1, 2",
)


def sql_runs(days: str) -> str:
    return (
        "select page_id, min(day) as first_day, max(day) as last_day, any_value(intervals) as intervals from (select *, sum(f) over (partition by page_id order by day) as g from (select *, "
        "case when lag(intervals) over w = intervals and lag(day) over w = day - 1 then 0 else 1 end as f from (" + days + ") window w as (partition by page_id order by day))) group by page_id, g"
    )


part(
    "page_hours",
    f"select page_id, string_agg(concat({_DAYS}[first_day+1], case when last_day > first_day then concat('-', {_DAYS}[last_day+1]) else '' end, ' ', intervals), '; ' order by first_day) as hours from ("
    + sql_runs("@page_days") + ") group by page_id",
)


@query("o7_compose_hours", "select page_id, hours from (@page_hours)")
def _(d: Data):
    return jsonld.compose_hours(jsonld.hours_specs(d.fx_pages))


# Day rows per order, to exercise runs of several shapes.
_DAY_ROWS = (
    "select l_orderkey as page_id, cast(l_linenumber % 7 as integer) as day, case when min(l_partkey) % 3 = 0 then '10:00-14:00' else '09:00-20:00' end as intervals from {0} group by 1, 2"
)


@query(
    "w9_day_runs",
    "select page_id, cast(first_day as integer) as first_day, cast(last_day as integer) as last_day, intervals from (" + sql_runs(_DAY_ROWS.format("@lineitem")) + ")",
)
def _(d: Data):
    shape = F.when(F.min("l_partkey") % 3 == 0, "10:00-14:00").otherwise("09:00-20:00")
    rows = d.lineitem.groupBy(
        F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") % 7).cast("int").alias("day")
    ).agg(shape.alias("intervals"))
    return jsonld.merge_day_runs(rows).select("page_id", "first_day", "last_day", "intervals")


@query(
    "o8_hours_validity",
    "select id, opening_hours_osm as hours, opening_hours_osm in (select schedule from (@parsed_schedules)) as valid from (@fx_places) where opening_hours_osm is not null",
)
def _(d: Data):
    rows = d.stores.where("opening_hours_osm is not null").select("id", F.col("opening_hours_osm").alias("hours"))
    return hours.split_valid_hours(rows, "hours").select("id", "hours", "valid")


@query(
    "o9_crawl_apply",
    "select id, coalesce(found, opening_hours_web) as opening_hours_web, case when crawled then timestamp '2026-06-03 10:00:00' end as checked_at from (select *, id % 5 = 0 as crawled, "
    "case when id % 10 = 0 then 'Mo-Fr 09:00-18:00' end as found from (@fx_places) where source_name = 'osm')",
)
def _(d: Data):
    stores = d.stores.where("source_name = 'osm'")
    results = stores.where("id % 5 = 0").select(
        "id", F.when(F.col("id") % 10 == 0, F.lit("Mo-Fr 09:00-18:00")).alias("hours")
    )
    now = F.lit("2026-06-03 10:00:00").cast("timestamp_ntz")
    return hours.apply_crawl(stores, results, now).select(
        "id", "opening_hours_web", F.col("hours_web_checked_at").alias("checked_at")
    )

"""Opening hours: schedule compilation, open-at-instant, selling verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.classify import lookup
from barrio.functions.text import js_trim
from barrio.operators.keyed import large_join
from barrio.session import materialise

ZONE = "Europe/Madrid"
DAY_MIN = 1440
WEEK_MIN = 7 * DAY_MIN
DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]

# No take-away sale from 22:00 to 09:00 local time.
ORDINANCE_FROM_MIN = 22 * 60
ORDINANCE_TO_MIN = 9 * 60
ORDINANCE_LABEL = "22:00–09:00"

# Usual schedules per type, used only without real hours.
DEFAULT_HOURS = {
    "bar": "Mo-Th 09:00-01:00; Fr-Sa 09:00-02:00; Su 10:00-24:00",
    "supermercado": "Mo-Sa 09:00-21:30; Su 10:00-15:00",
    "alimentacion": "Mo-Su 10:00-22:00",
    "bodega": "Mo-Sa 10:00-14:00,17:00-20:30",
    "tienda_24h": "24/7",
    "gasolinera": "Mo-Su 06:00-24:00",
}

# Verdict texts.
REASONS = {
    "unknown": "Horario no confirmado.",
    "closed": "Cerrado.",
    "closed_estimated": "Suele estar cerrado a esta hora (horario no confirmado).",
    "bar": "Bar abierto en horario habitual.",
    "bar_website": "Bar abierto (horario de su web).",
    "bar_estimated": "Suele estar abierto a esta hora (horario no confirmado).",
    "no_takeaway": "No vende alcohol para llevar.",
    "ordinance": f"Ordenanza municipal: no puede vender alcohol para llevar de {ORDINANCE_LABEL}.",
    "shop": "Abierto. Puede venderte cerveza para llevar.",
    "shop_website": "Abierto (horario de su web). Puede venderte cerveza para llevar.",
    "shop_estimated": "Suele estar abierto (horario no confirmado). Puede venderte cerveza para llevar.",
}


# --- precedence ---------------------------------------------------------------


def effective_hours(osm: Column, web: Column, place_type: Column) -> tuple[Column, Column]:
    """(schedule text, source): mapped hours, else website hours, else the usual ones."""
    osm, web = (F.nullif(js_trim(c), F.lit("")) for c in (osm, web))
    usual = lookup(DEFAULT_HOURS, F.coalesce(place_type, F.lit("otro")))
    source = (
        F.when(osm.isNotNull(), "osm").when(web.isNotNull(), "website")
        .when(usual.isNotNull(), "estimated").otherwise("none")
    )
    return F.coalesce(osm, web, usual), source


# --- schedule compilation -----------------------------------------------------

_DAY = "(?:Mo|Tu|We|Th|Fr|Sa|Su)"
_SELECTOR = rf"(?:{_DAY}(?:\s*-\s*{_DAY})?|PH|SH)"
_SELECTORS = rf"{_SELECTOR}(?:\s*,\s*{_SELECTOR})*"
_SPAN = r"[0-9]{1,2}:[0-5][0-9]\s*-\s*[0-9]{1,2}:[0-5][0-9]"
_TIMES = rf"(?:24/7|off|closed|{_SPAN}(?:\s*,\s*{_SPAN})*)"
_RULE = rf"^(?:({_SELECTORS})(?:\s+|$))?({_TIMES})?$"


def _minutes(text: Column) -> Column:
    part = lambda i: F.get(F.split(text, ":"), F.lit(i)).try_cast("int")
    return part(0) * 60 + part(1)


def _rule_days(selectors: Column) -> Column:
    """Weekday numbers of a selector list; no selector means every day, PH/SH means none."""
    numbers = {d: i for i, d in enumerate(DAYS)}

    def days(item: Column) -> Column:
        ends = F.transform(F.split(item, r"\s*-\s*"), lambda d: lookup(numbers, d))
        first, last = F.get(ends, F.lit(0)), F.get(ends, F.size(ends) - 1)
        run = F.sequence(first, F.when(last < first, last + 7).otherwise(last))
        return F.when(first.isNull(), F.array().cast("array<int>")).otherwise(
            F.transform(run, lambda d: d % 7)
        )

    listed = F.flatten(F.transform(F.split(selectors, r"\s*,\s*"), days))
    every = F.sequence(F.lit(0), F.lit(6))
    return F.when(F.coalesce(selectors, F.lit("")) == "", every).otherwise(listed)


def _rule_spans(times: Column) -> Column:
    """Opening spans in minutes of the day; overnight spans end past 1440."""

    def span(text: Column) -> Column:
        ends = F.split(text, r"\s*-\s*")
        start, end = _minutes(F.get(ends, F.lit(0))), _minutes(F.get(ends, F.lit(1)))
        return F.struct(
            start.alias("s"), F.when(end <= start, end + DAY_MIN).otherwise(end).alias("e")
        )

    whole = F.array(F.struct(F.lit(0).alias("s"), F.lit(DAY_MIN).alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return (
        F.when(times == "24/7", whole)
        .when(times.isin("off", "closed"), none)
        .when(times == "", whole)
        .otherwise(F.transform(F.split(times, r"\s*,\s*"), span))
    )


def compile_schedules(schedules: DataFrame) -> DataFrame:
    """One row per distinct schedule: `parsed` and its `open` intervals on the week circle.

    `schedules` has a `schedule` column. Each interval is (start, end, until): start and end in
    minutes from Monday 00:00, and the minute at which the opening really ends, which differs
    from `end` only where it runs over the week's end and is null for an opening that never ends.
    A later rule replaces an earlier one on the days both name; the tail of an overnight span
    stays. Text outside the supported grammar is not parsed and counts as closed.
    """
    text = js_trim(F.col("schedule"))
    rules = F.filter(F.transform(F.split(text, ";"), js_trim), lambda r: r != "")
    well_formed = lambda r: r.rlike(_RULE)

    def rule(r: Column) -> Column:
        times = F.regexp_extract(r, _RULE, 2)
        return F.struct(
            _rule_days(F.regexp_extract(r, _RULE, 1)).alias("days"), _rule_spans(times).alias("spans")
        )

    def hour_fits(r: Column) -> Column:
        starts = F.regexp_extract_all(r, F.lit(r"([0-9]{1,2}):[0-5][0-9]\s*-"), F.lit(1))
        ends = F.regexp_extract_all(r, F.lit(r"-\s*([0-9]{1,2}:[0-5][0-9])"), F.lit(1))
        return F.forall(starts, lambda h: h.try_cast("int") < 24) & F.forall(
            ends, lambda e: _minutes(e) <= 2 * DAY_MIN
        )

    parsed = (F.size(rules) > 0) & F.forall(rules, lambda r: well_formed(r) & hour_fits(r))

    def on_day(day: Column) -> Column:
        last = F.element_at(F.filter("rules", lambda r: F.array_contains(r["days"], day)), -1)
        return F.transform(
            last["spans"],
            lambda s: F.struct((s["s"] + day * DAY_MIN).alias("s"), (s["e"] + day * DAY_MIN).alias("e")),
        )

    def days_with_rule(day: Column) -> Column:
        return F.exists("rules", lambda r: F.array_contains(r["days"], day))

    every = F.filter(F.sequence(F.lit(0), F.lit(6)), days_with_rule)
    clip = lambda s, lo, hi, move: F.struct(
        (F.greatest(s["s"], F.lit(lo)) - move).alias("s"), (F.least(s["e"], F.lit(hi)) - move).alias("e")
    )
    spans = F.col("spans")
    on_circle = F.array_sort(
        F.concat(
            F.transform(spans, lambda s: clip(s, 0, WEEK_MIN, 0)),
            F.transform(
                F.filter(spans, lambda s: s["e"] > WEEK_MIN), lambda s: clip(s, WEEK_MIN, 2 * WEEK_MIN, WEEK_MIN)
            ),
        )
    )

    def absorb(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], s["e"]).alias("e"))
        touches = F.coalesce(s["s"] <= last["e"], F.lit(False))
        return F.when(
            touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))
        ).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(F.col("circle"), F.array().cast("array<struct<s:int,e:int>>"), absorb)
    head = F.try_element_at("merged", F.lit(1))
    carries = (F.col("e_last") == WEEK_MIN) & (head["s"] == 0)
    until = lambda s: (
        F.when((s["s"] == 0) & (s["e"] == WEEK_MIN), F.lit(None).cast("int"))
        .when((s["e"] == WEEK_MIN) & carries, head["e"])
        .otherwise(s["e"])
    )
    return (
        schedules.select("schedule").where("schedule is not null").distinct()
        .withColumn("parsed", parsed)
        .withColumn("rules", F.when(F.col("parsed"), F.transform(rules, rule)))
        .withColumn("spans", F.flatten(F.transform(every, on_day)))
        .withColumn("circle", on_circle)
        .withColumn("merged", merged)
        .withColumn("e_last", F.try_element_at("merged", F.lit(-1))["e"])
        .select(
            "schedule", "parsed",
            F.coalesce(
                F.transform(
                    "merged",
                    lambda s: F.struct(s["s"].alias("start_min"), s["e"].alias("end_min"), until(s).alias("until_min")),
                ),
                F.array().cast("array<struct<start_min:int,end_min:int,until_min:int>>"),
            ).alias("open_spans"),
        )
    )


def schedule_intervals(compiled: DataFrame) -> DataFrame:
    """The compiled schedules as interval rows."""
    return compiled.select("schedule", F.explode("open_spans").alias("i")).select("schedule", "i.*")


# --- instants -----------------------------------------------------------------


def local_time(instant: Column) -> Column:
    """Local wall-clock of a UTC instant held as a zone-less timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), instant)


def minute_of_day(instant: Column) -> Column:
    """Local minute of the day, 0 to 1439."""
    local = local_time(instant)
    return F.hour(local) * 60 + F.minute(local)


def minute_of_week(instant: Column) -> Column:
    """Local minute of the week from Monday 00:00."""
    return F.weekday(local_time(instant)) * DAY_MIN + minute_of_day(instant)


def takeaway_prohibited(instant: Column) -> Column:
    """The sale ordinance applies at the instant."""
    minute = minute_of_day(instant)
    return (minute >= ORDINANCE_FROM_MIN) | (minute < ORDINANCE_TO_MIN)


def clock_text(minute: Column) -> Column:
    """HH:MM of a minute of the week."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    of_day = minute % DAY_MIN
    return F.concat(two(F.floor(of_day / 60)), F.lit(":"), two(of_day % 60))


def compiled_schedules(df: DataFrame, column: str) -> DataFrame:
    """schedule, open_spans of the distinct texts of a column, written, as the compiled form is read by every row."""
    used = df.where(F.col(column).isNotNull()).select(F.col(column).alias("schedule")).distinct()
    return materialise(compile_schedules(used), "schedules").select("schedule", "open_spans")


def attach_schedules(df: DataFrame, column: str, compiled: DataFrame | None = None) -> DataFrame:
    """Add the compiled `open_spans` of a schedule column, from `compiled` if that is at hand."""
    if compiled is None:
        compiled = compiled_schedules(df, column)
    return df.join(compiled.withColumnRenamed("schedule", column), column, "left")


def open_state(open_spans: Column, week_minute: Column) -> tuple[Column, Column]:
    """(open, closes_at) at a minute of the week; never open without a compiled schedule.

    Pass the minute as a plain column: it is compared with every span.
    """
    current = F.get(
        F.filter(open_spans, lambda s: (s["start_min"] <= week_minute) & (week_minute < s["end_min"])), F.lit(0)
    )
    return current.isNotNull(), F.when(current["until_min"].isNotNull(), clock_text(current["until_min"]))


def verdict(place_type: Column, takeaway: Column, source: Column, is_open: Column,
            closes_at: Column, prohibited: Column) -> Column:
    """The open-now block: state, closing time, sale right now, reason and hours source."""
    place_type = F.coalesce(place_type, F.lit("otro"))
    known, is_bar, estimated, web = (
        source != "none", place_type == "bar", source == "estimated", source == "website",
    )
    is_open = known & is_open
    text = {k: F.lit(v) for k, v in REASONS.items()}
    by_source = lambda kind: (
        F.when(estimated, text[f"{kind}_estimated"]).when(web, text[f"{kind}_website"]).otherwise(text[kind])
    )
    reason = (
        F.when(~known, text["unknown"])
        .when(~is_open & estimated, text["closed_estimated"])
        .when(~is_open, text["closed"])
        .when(is_bar, by_source("bar"))
        .when(~takeaway, text["no_takeaway"])
        .when(prohibited, text["ordinance"])
        .otherwise(by_source("shop"))
    )
    sells = is_open & (is_bar | (takeaway & ~prohibited))
    return F.struct(
        is_open.alias("open"),
        F.when(is_open, closes_at).alias("closes_at"),
        sells.alias("sells_beer_now"),
        reason.alias("reason"),
        source.alias("hours_source"),
    )


def with_hours(places: DataFrame) -> DataFrame:
    """Add the schedule that holds for a place and where it comes from, as `_hours` and `_source`."""
    hours, source = effective_hours(
        F.col("opening_hours_osm"), F.col("opening_hours_web"), F.col("place_type")
    )
    return places.select("*", hours.alias("_hours"), source.alias("_source"))


def states_at(compiled: DataFrame, minutes: DataFrame) -> DataFrame:
    """_hours, _week, _open, _closes: the schedules that are open at the minutes of the week asked for (column `_week`).

    A schedule has one row at most for each of the 10,080 minutes. A place and an instant then find their state by equality.
    """
    spans = compiled.select("schedule", F.explode("open_spans").alias("s")).select(
        F.col("schedule").alias("_hours"), F.col("s.until_min").alias("until"),
        F.explode(F.sequence("s.start_min", F.col("s.end_min") - 1)).alias("_week"),
    )
    asked = minutes.select("_week").distinct()
    found = spans.join(asked, "_week", "left_semi")
    closes = F.when(F.col("until").isNotNull(), clock_text(F.col("until")))
    return materialise(found.select("_hours", "_week", F.lit(True).alias("_open"), closes.alias("_closes")), "states")


def with_open_now(df: DataFrame, instant: str) -> DataFrame:
    """Add the `open_now` struct to rows of places at instants.

    Needs place_type, sells_takeaway_beer, opening_hours_osm and opening_hours_web.
    """
    rows = attach_schedules(with_hours(df).withColumn("_week", minute_of_week(F.col(instant))), "_hours")
    is_open, closes_at = open_state(F.col("open_spans"), F.col("_week"))
    # The state leaves through a generator, so that a later filter on it is not folded back into
    # a second search of the spans.
    rows = rows.select("*", F.inline(F.array(F.struct(is_open.alias("_open"), closes_at.alias("_closes")))))
    return with_verdict(rows.drop("open_spans"))


def sells_at(place_type: Column, takeaway: Column, is_open: Column, week_minute: Column) -> Column:
    """The sale verdict alone, of a place whose schedule is open or not at a minute of the week."""
    day_minute = week_minute % DAY_MIN
    prohibited = (day_minute >= ORDINANCE_FROM_MIN) | (day_minute < ORDINANCE_TO_MIN)
    return is_open & ((F.coalesce(place_type, F.lit("otro")) == "bar") | (takeaway & ~prohibited))


def with_verdict(rows: DataFrame) -> DataFrame:
    """Add `open_now` and `takeaway_prohibited` to rows with _source, _week, _open and _closes; these and _hours go."""
    day_minute = F.col("_week") % DAY_MIN
    prohibited = (day_minute >= ORDINANCE_FROM_MIN) | (day_minute < ORDINANCE_TO_MIN)
    block = verdict(
        F.col("place_type"), F.col("sells_takeaway_beer"), F.col("_source"), F.col("_open"), F.col("_closes"), prohibited
    )
    rows = rows.withColumns({"open_now": block, "takeaway_prohibited": prohibited})
    return rows.drop("_hours", "_source", "_week", "_open", "_closes")


# --- validity and crawl results -----------------------------------------------


def split_valid_hours(df: DataFrame, column: str) -> DataFrame:
    """Add `valid`: the hours text is one that compiles."""
    compiled = compile_schedules(df.select(F.col(column).alias("schedule")))
    known = compiled.select(F.col("schedule").alias(column), F.col("parsed").alias("valid"))
    out = df.join(known, column, "left")
    return out.withColumn("valid", F.coalesce("valid", F.lit(False)))


def apply_crawl(stores: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Next stores after a crawl: new hours where found, checked time on success and failure.

    `results` has one row per crawled store: id, hours (null for a failure).
    """
    found = results.select("id", F.col("hours").alias("_hours"), F.lit(True).alias("_seen"))
    joined = large_join(stores, found, "id", "left")
    return (
        joined.withColumn("opening_hours_web", F.coalesce("_hours", "opening_hours_web"))
        .withColumn("hours_web_checked_at", F.when(F.col("_seen"), now).otherwise(F.col("hours_web_checked_at")))
        .drop("_hours", "_seen")
    )

"""Schedules, verdicts and page hours."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from barrio.operators import hours, jsonld


def at(day, hh, mm, offset=2):
    """A UTC instant from a local summer time."""
    return datetime.datetime.fromisoformat(f"{day}T{hh:02d}:{mm:02d}:00") - datetime.timedelta(hours=offset)


WED = "2026-06-03"


@pytest.mark.parametrize("offset,day", [(2, WED), (1, "2026-01-15")])
def test_ordinance_boundaries(spark, offset, day):
    marks = {(13, 0): False, (21, 59): False, (22, 0): True, (2, 0): True, (8, 59): True, (9, 0): False}
    df = spark.createDataFrame([(at(day, *k, offset),) for k in marks], "t timestamp_ntz")
    assert [r[0] for r in df.select(hours.takeaway_prohibited(F.col("t"))).collect()] == list(marks.values())


def states(spark, cases):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "id int, place_type string, sells_takeaway_beer boolean, opening_hours_osm string, opening_hours_web string, t timestamp_ntz",
    )
    return [r.open_now for r in hours.with_open_now(df, "t").orderBy("id").collect()]


def test_verdicts(spark):
    shop, bar = ("alimentacion", True), ("bar", False)
    cases = [
        ((*shop, "Mo-Sa 09:00-22:00", None, at(WED, 13, 0)), True, "22:00", True, "osm", "Abierto."),
        ((*shop, "Mo-Sa 09:00-22:00", None, at(WED, 22, 0)), False, None, False, "osm", "Cerrado."),
        ((*shop, "Mo-Su 09:00-23:00", None, at(WED, 22, 30)), True, "23:00", False, "osm", "Ordenanza"),
        ((*bar, "Mo-Su 09:00-02:00", None, at(WED, 23, 30)), True, "02:00", True, "osm", "Bar abierto"),
        ((*bar, "Mo-Su 09:00-02:00", None, at(WED, 3, 0)), False, None, False, "osm", "Cerrado."),
        ((*bar, None, None, at(WED, 0, 30)), True, "01:00", True, "estimated", "Suele estar abierto"),
        ((*bar, None, None, at("2026-06-06", 1, 30)), True, "02:00", True, "estimated", "Suele estar abierto"),
        ((*bar, None, None, at(WED, 2, 30)), False, None, False, "estimated", "Suele estar cerrado"),
        (("otro", False, "  ", None, at(WED, 13, 0)), False, None, False, "none", "Horario no confirmado"),
        (("tienda_24h", True, "24/7", None, at(WED, 4, 0)), True, None, False, "osm", "Ordenanza"),
        (("gasolinera", True, "PH,Mo-Su 00:00-24:00", None, at(WED, 13, 0)), True, None, True, "osm", "Abierto."),
        ((*shop, None, "Mo-Fr 10:00-20:00", at(WED, 12, 0)), True, "20:00", True, "website", "Abierto (horario de su web)"),
        ((*shop, "garbage", None, at(WED, 12, 0)), False, None, False, "osm", "Cerrado."),
        (("alimentacion", False, "24/7", None, at(WED, 12, 0)), True, None, False, "osm", "No vende alcohol"),
        ((*shop, "Mo-Fr 09:00-18:00; We off", None, at(WED, 12, 0)), False, None, False, "osm", "Cerrado."),
        ((*bar, "Mo-Su 20:00-02:00", None, at("2026-06-08", 1, 0)), True, "02:00", True, "osm", "Bar abierto"),
    ]
    got = states(spark, [c[0] for c in cases])
    for block, (_, is_open, closes, sells, source, reason) in zip(got, cases):
        assert (block.open, block.closes_at, block.sells_beer_now, block.hours_source) == (is_open, closes, sells, source), block
        assert block.reason.startswith(reason)


def page(ld):
    return f"<html><script type='application/ld+json;charset=utf-8'>{json.dumps(ld)}</script></html>"


def spec(days, opens, closes):
    return {"openingHoursSpecification": {"dayOfWeek": days, "opens": opens, "closes": closes}}


PAGES = [
    (page({"openingHoursSpecification": [spec(["https://schema.org/Monday", "Tuesday", "wed"], "09:00", "20:00")["openingHoursSpecification"]]}), "Mo-We 09:00-20:00"),
    (page([spec("Saturday", "10:00", "14:00"), spec("Saturday", "17:00", "21:00")]), "Sa 10:00-14:00,17:00-21:00"),
    (page(spec("Friday", "12:00", "00:00")), "Fr 12:00-24:00"),
    (page({"@graph": [{"@type": "WebSite"}, {"department": [spec("Sunday", "11:00", "16:00")]}]}), "Su 11:00-16:00"),
    (page(spec("Monday", "9:00", "20:00:00")), "Mo 09:00-20:00"),
    (page({"openingHours": ["Mo-Sa 11:00-14:30", "Su 12:00-15:00"]}), "Mo-Sa 11:00-14:30; Su 12:00-15:00"),
    (page({"openingHours": "Tu,Th 16:00-20:00"}), "Tu 16:00-20:00; Th 16:00-20:00"),
    (page({"openingHours": "Sa-Mo 16:00-20:00"}), None),
    ("<html>hola</html>", None),
    (page({"openingHoursSpecification": {"opens": "09:00", "closes": "20:00"}}), None),
    (page(spec("Monday", "09:00", "09:00")), None),
    (page(spec("Monday", "25:99", "closed")), None),
    (page(spec("Monday", 9, 20)), None),
    ("<script type=\"application/ld+json\">{oops</script>" + page(spec("Mo", "10:00", "12:00")), "Mo 10:00-12:00"),
]


def test_page_hours(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(PAGES)], "page_id int, html string")
    found = {r.page_id: r.hours for r in jsonld.compose_hours(jsonld.hours_specs(df)).collect()}
    assert found == {i: want for i, (_, want) in enumerate(PAGES) if want}


def test_nesting_stops_at_the_depth_limit(spark):
    node = spec("Monday", "10:00", "12:00")
    deep = {7: node}
    for level in range(6, -1, -1):
        deep[level] = {"mainEntity": deep[level + 1]}
    rows = [(0, page(deep[0])), (1, page(deep[1]))]
    df = spark.createDataFrame(rows, "page_id int, html string")
    assert [r.page_id for r in jsonld.compose_hours(jsonld.hours_specs(df)).collect()] == [1]

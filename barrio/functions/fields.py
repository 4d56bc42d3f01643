"""Addresses, names and web links out of source fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barrio.functions import links
from barrio.functions.text import blank_to_null, js_trim


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def osm_address(street: Column, number: Column) -> Column:
    """Street and number, null if neither is given."""
    return blank_to_null(F.concat_ws(" ", _filled(street), _filled(number)))


def website_url(website: Column, contact: Column) -> Column:
    """Canonical http(s) link of a business, null for anything that is not one; a bare host counts as https."""
    raw = js_trim(F.coalesce(website, contact, F.lit("")))
    full = F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))
    fine = (
        (raw != "") & (F.length(raw) <= 500) & ~raw.rlike(r"(?U)\s") & full.rlike(r"(?i)^https?://")
        & links.link_parts(full)["host"].contains(".")
    )
    return F.when(fine, links.canonical(full))


def madrid_address(road_class: Column, road: Column, number: Column, qualifier: Column) -> Column:
    """The filled parts of a Madrid address joined by spaces."""
    return F.trim(F.concat_ws(" ", *map(_filled, (road_class, road, number, qualifier))))


def bcn_address(road: Column, first: Column, first_letter: Column, last: Column, last_letter: Column) -> Column:
    """Road with its number or number range; null without a road."""
    join = lambda a, b: js_trim(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    start, end, name = join(first, first_letter), join(last, last_letter), blank_to_null(road)
    numbers = F.when((start != "") & (end != "") & (end != start), F.concat_ws("-", start, end)).otherwise(start)
    return F.when(name.isNotNull(), F.concat_ws(" ", name, _filled(numbers)))


def display_name(name: Column, activity: Column, no_name: str | None = None) -> Column:
    """Commercial name, else the activity label; `no_name` is a source's placeholder."""
    own = blank_to_null(name)
    if no_name:
        own = F.when(F.upper(own) != no_name, own)
    return F.coalesce(own, js_trim(activity), F.lit(""))


def municipality(body: Column) -> Column:
    """Place name out of "Ajuntament de X" or "Ajuntament d'X"."""
    return blank_to_null(F.regexp_replace(js_trim(body), r"(?i)^Ajuntament\s+(de\s+|d')", ""))

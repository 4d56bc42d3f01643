"""Access-log analytics and visitor location."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.geo import BOXES, haversine_km, in_box
from barrio.functions.text import once
from barrio.operators.keyed import keyed_join

# Metropolitan areas (name, lat, lng) and catchment.
METROS = [
    ("Madrid", 40.4168, -3.7038), ("Barcelona", 41.3874, 2.1686), ("Valencia", 39.4699, -0.3763),
    ("Sevilla", 37.3891, -5.9845), ("Zaragoza", 41.6488, -0.8891), ("Málaga", 36.7213, -4.4214),
    ("Murcia", 37.9922, -1.1307), ("Palma de Mallorca", 39.5696, 2.6502),
    ("Las Palmas", 28.1235, -15.4363), ("Bilbao", 43.2630, -2.9350),
    ("Alicante", 38.3452, -0.4810), ("Córdoba", 37.8882, -4.7794),
    ("Valladolid", 41.6523, -4.7245), ("Vigo", 42.2406, -8.7207), ("Granada", 37.1773, -3.5986),
    ("A Coruña", 43.3623, -8.4115), ("Gijón", 43.5322, -5.6611),
    ("Santa Cruz de Tenerife", 28.4636, -16.2518), ("Pamplona", 42.8125, -1.6458),
    ("San Sebastián", 43.3183, -1.9812), ("Santander", 43.4623, -3.8099),
]
METRO_KM = 45.0
ELSEWHERE = "Otras zonas"


def _parameter(uri: Column, key: str) -> Column:
    """The last numeric value of a query parameter."""
    found = F.regexp_extract_all(uri, F.lit(rf"[?&]{key}=(-?[0-9]+\.?[0-9]*)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def located_requests(log: DataFrame) -> DataFrame:
    """Requests that look at a position, with lat and lng: their point, or the centre of their box.

    Log: uri and more. Each parameter is searched once per request: the values leave through a
    generator, which the optimiser does not fold into the later tests.
    """
    keys = ["lat", "lng", "north", "south", "east", "west"]
    values = F.struct(*[_parameter(F.col("uri"), k).alias(f"_{k}") for k in keys])
    near = F.col("uri").contains("/api/stores/nearby")
    boxed = F.col("uri").contains("/api/stores/map") | F.col("uri").contains("/api/stores/clusters")
    parsed = log.select("*", near.alias("_near"), boxed.alias("_boxed"), F.inline(F.array(values)))
    point = F.expr("_near and _lat is not null and _lng is not null")
    centre = F.expr("_boxed and _north + _south + _east + _west is not null")
    pick = lambda own, a, b: F.when(point, F.col(own)).when(centre, (F.col(a) + F.col(b)) / F.lit(2.0))
    kept = parsed.where(point | centre)
    return kept.select(*log.columns, pick("_lat", "_north", "_south").alias("lat"), pick("_lng", "_east", "_west").alias("lng"))


def log_day(epoch: Column, text: Column) -> Column:
    """UTC day of a request from a numeric or textual time, '?' without either."""
    days = F.floor(epoch / F.lit(86400.0)).cast("int")
    from_epoch = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.coalesce(from_epoch, F.when(F.length(text) >= 10, F.substring(text, 1, 10)), F.lit("?"))


def visitor(remote_ip: Column, client_ip: Column, remote_addr: Column) -> Column:
    """First non-empty address of a request, '?' without any."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (remote_ip, client_ip, remote_addr)], F.lit("?"))


def with_metro(located: DataFrame, out: str = "area") -> DataFrame:
    """Add the nearest area within the catchment; of equally near ones the last listed.

    Needs lat and lng. The nearest is found by the largest product of unit vectors, three
    multiplications per listed area; only the winner's distance is worked out.
    """
    phi, lam = F.radians("lat"), F.radians("lng")
    axes = located.select(
        "*", (F.cos(phi) * F.cos(lam)).alias("_x"), (F.cos(phi) * F.sin(lam)).alias("_y"), F.sin(phi).alias("_z")
    )

    def candidate(order: int, name: str, lat: float, lng: float) -> Column:
        p, q = math.radians(lat), math.radians(lng)
        dot = (
            F.col("_x") * (math.cos(p) * math.cos(q)) + F.col("_y") * (math.cos(p) * math.sin(q))
            + F.col("_z") * math.sin(p)
        )
        return F.struct(
            dot.alias("dot"), F.lit(order).alias("order"), F.lit(name).alias("name"),
            F.lit(lat).alias("lat"), F.lit(lng).alias("lng"),
        )

    best = F.greatest(*[candidate(i, *metro) for i, metro in enumerate(METROS)])
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("_m.lat"), F.col("_m.lng"))
    area = F.when(km <= METRO_KM, F.col("_m.name")).otherwise(ELSEWHERE)
    return axes.withColumn("_m", best).withColumn(out, area).drop("_x", "_y", "_z", "_m")


def searches(log: DataFrame) -> DataFrame:
    """Distinct (day, ip, area) of located requests. Log: day, ip, uri.

    The area is resolved per row in the scan stage; duplicates collapse before the shuffle.
    """
    return with_metro(located_requests(log)).select("day", "ip", "area").distinct()


def top_areas(triples: DataFrame) -> DataFrame:
    """Distinct visitors per area, with the share of the sum over areas.

    The total spans the few area rows of a fixed list, taken as a scalar.
    """
    areas = triples.select("ip", "area").distinct().groupBy("area").agg(F.count(F.lit(1)).alias("visitors"))
    total = areas.agg(F.sum("visitors")).scalar()
    return areas.withColumn("share", F.col("visitors") / total)


def daily_activity(triples: DataFrame, days: int = 21) -> DataFrame:
    """The last days with data: distinct visitors and the busiest area (by name on ties)."""
    known = triples.where("day <> '?'")
    per_area = known.groupBy("day", "area").agg(F.count(F.lit(1)).alias("n"))
    top = per_area.groupBy("day").agg(F.min(F.struct((-F.col("n")).alias("n"), "area")).alias("t"))
    visitors = known.groupBy("day").agg(F.countDistinct("ip").alias("visitors"))
    return (
        visitors.join(top, "day")
        .select("day", "visitors", F.col("t.area").alias("top_area"), (-F.col("t.n")).alias("top_visitors"))
        .orderBy(F.desc("day")).limit(days)
    )


# --- address to city ----------------------------------------------------------


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number, null when malformed."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    valid = ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("bigint")
    return F.when(valid, ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


def locate_visitors(visits: DataFrame, ranges: DataFrame) -> DataFrame:
    """City of each distinct address in a table of disjoint number ranges.

    A range is cut into aligned blocks: per power of two it uses, at most two at its ends. An
    address looks up its enclosing block of each size in use, so wide ranges cost no more than
    narrow ones. Locations outside Spain, unknown or malformed addresses give source 'none'.
    """
    inside = ranges.where(in_box(F.col("lat"), F.col("lng"), BOXES["spain"]))
    sized = inside.withColumn(
        "_bits", F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")
    )
    # A range no longer than one block touches at most two blocks; an address has 32 bits.
    block = lambda value: F.floor(F.col(value) / F.pow(F.lit(2.0), F.col("_bits"))).cast("bigint")
    by_block = sized.withColumn("_block", F.explode(F.array_distinct(F.array(block("lo"), block("hi")))))
    numbered = visits.select("ip").distinct().withColumn("_n", ip_number(F.col("ip")))
    keyed = numbered.withColumn(
        "_bits", F.explode(F.array(*[F.lit(b) for b in range(33)]))
    ).withColumn("_block", block("_n"))
    found = keyed_join(
        keyed, by_block, ["_bits", "_block"], F.col("_n").between(F.col("lo"), F.col("hi")),
    ).select("ip", "lat", "lng", F.coalesce("city_es", "city_en").alias("city"), F.lit("ip").alias("source"))
    return (
        numbered.select("ip").join(found, "ip", "left")
        .withColumn("source", F.coalesce("source", F.lit("none")))
    )


# --- address to city by network prefix ------------------------------------------


def ip_halves(ip: Column) -> Column:
    """Both halves of an address as bigints (`hi`, `lo`), null when malformed.

    IPv4 addresses stand in the 128-bit space as ::ffff:a.b.c.d, so both families are looked up alike.
    """
    return once(once(once(F.lower(ip), _in_groups), _filled_groups), _halves)


def _in_groups(text: Column) -> Column:
    """The address in groups of hexadecimal digits alone; its last two may be given as an IPv4 address."""
    four = once(
        ip_number(F.regexp_extract(text, r"([0-9.]+)$", 1)),
        lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(0xFFFF)))),
    )
    head = F.regexp_extract(text, r"^(|.*:)[0-9.]+$", 1)
    return F.when(~text.contains("."), text).when(
        text.rlike(r"^(|.*:)[0-9.]+$"),
        F.when(ip_number(F.regexp_extract(text, r"([0-9.]+)$", 1)).isNotNull(), F.concat(F.when(head == "", "::ffff:").otherwise(head), four)),
    )


def _filled_groups(text: Column) -> Column:
    """All eight groups, those that a double colon stands for as zeros; null for any other number of groups."""
    words = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def joined(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        missing = 8 - F.size(left) - F.size(right)
        return F.when(
            (F.size(sides) == 2) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        ).when((F.size(sides) == 1) & (F.size(left) == 8), left)

    return once(F.transform(F.split(text, "::", -1), words), joined)


def _halves(groups: Column) -> Column:
    word = lambda i: F.conv(F.get(groups, F.lit(i)), 16, 10).cast("bigint")
    half = lambda i: (
        F.shiftleft(word(i), 48).bitwiseOR(F.shiftleft(word(i + 1), 32)).bitwiseOR(F.shiftleft(word(i + 2), 16))
        .bitwiseOR(word(i + 3))
    )
    fine = F.forall(groups, lambda w: w.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fine, F.struct(half(0).alias("hi"), half(4).alias("lo")))


def _network(halves: Column, bits: Column) -> Column:
    """The first `bits` bits of an address, the rest zero."""
    ones = F.lit(-1).cast("bigint")
    cut = lambda kept: (
        F.when(kept <= 0, F.lit(0).cast("bigint")).when(kept >= 64, ones).otherwise(F.call_function("shiftleft", ones, 64 - kept))
    )
    return F.struct(
        halves["hi"].bitwiseAND(cut(bits)).alias("hi"), halves["lo"].bitwiseAND(cut(bits - 64)).alias("lo")
    )


def locate_by_prefix(visits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """City of each distinct address by the longest network that holds it, IPv4 and IPv6 alike.

    Visits: ip. Prefixes: network (address/bits), lat, lng, city_es, city_en; networks may lie inside others. An
    address looks up its own beginning once per length in use (at most 129), so the join is by equality and a wide
    network costs no more than a narrow one. Of a repeated network the first by city and position counts. The longest
    network decides before the country does: outside Spain, unknown, malformed or null addresses give source 'none',
    malformed networks are left out.
    """
    address, length = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1)
    given = F.when(length.rlike("^[0-9]{1,3}$"), length.cast("int"))
    bits = F.when(address.contains(":"), F.when(given <= 128, given)).when(given <= 32, given + 96)
    city = F.coalesce("city_es", "city_en").alias("city")
    parsed = prefixes.select(ip_halves(address).alias("_a"), bits.alias("_bits"), "lat", "lng", city)
    table = parsed.where("_a is not null and _bits is not null").select(
        "_bits", _network(F.col("_a"), F.col("_bits")).alias("_n"), "lat", "lng", "city"
    )
    lengths = table.agg(F.collect_set("_bits").alias("all")).scalar()
    known = visits.select("ip").distinct()
    looked_up = known.select("ip", ip_halves(F.col("ip")).alias("_a")).where("_a is not null").select(
        "ip", "_a", F.explode(lengths).alias("_bits")
    ).select("ip", "_bits", _network(F.col("_a"), F.col("_bits")).alias("_n"))
    found = keyed_join(
        looked_up.select("ip", "_bits", "_n.hi", "_n.lo"), table.select("_bits", "_n.hi", "_n.lo", "lat", "lng", "city"),
        ["_bits", "hi", "lo"],
    )
    longest = found.groupBy("ip").agg(F.min(F.struct((-F.col("_bits")).alias("_bits"), "city", "lat", "lng")).alias("_b"))
    inside = longest.select("ip", "_b.lat", "_b.lng", "_b.city").where(in_box(F.col("lat"), F.col("lng"), BOXES["spain"]))
    return known.join(inside.withColumn("source", F.lit("ip")), "ip", "left").withColumn(
        "source", F.coalesce("source", F.lit("none"))
    )

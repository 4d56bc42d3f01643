"""Rule cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from barrio.functions import classify, fields, geo, links, text
from barrio.operators import serve, traffic


def values(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_name_forms(spark):
    rows = [("  Café   Ñandú 24h ",), ("PARAL·LEL",), (None,), ("L'Àvia & Fills",), ("´^`",)]
    out = values(spark, "s string", rows, f=text.fold_upper(F.col("s")), m=text.match_name(F.col("s")),
                 a=text.activity_text(F.col("s")))
    assert out == [
        ("CAFE NANDU 24H", "CAFE NANDU 24H", "CAFE NANDU 24H"), ("PARALLEL", "PARALLEL", "PARALLEL"),
        ("", "", ""), ("L'AVIA & FILLS", "L AVIA FILLS", "L AVIA FILLS"), ("", "", ""),
    ]


def test_dice(spark):
    rows = [("", ""), ("A B", "A B"), ("A B", "A C"), ("A", ""), ("BAR PACO", "PACO BAR"), ("A A B", "A B")]
    out = [r[0] for r in values(spark, "a string, b string", rows, d=text.dice_tokens(F.col("a"), F.col("b")))]
    assert out == pytest.approx([0, 1, 0.5, 0, 1, 1])


def test_generic_names(spark):
    rows = [("BAR",), ("ESTABLIMENT DE BEGUDES",), ("bar 24h",), ("BAR PACO",), ("",), ("BARBERIA",)]
    out = [r[0] for r in values(spark, "s string", rows, g=text.is_generic_name(F.col("s")))]
    assert out == [True, True, True, False, False, False]
    words = set(text.GENERIC_TOKENS)
    assert all(set(name.split()) <= words for name in text.GENERIC_NAMES)


def test_chain_word_boundaries(spark):
    rows = [("SUPER DIA",), ("DIARIO",), ("DIA-MARKET",), ("MEDIA",), ("DIA_X",), ("DIAÑ",), ("",)]
    out = [r[0] for r in values(spark, "s string", rows, c=text.chain_flag(F.col("s"), ["DIA", "LIDL"]))]
    assert out == [True, False, True, False, False, True, False]


def test_chain_table_beyond_inline_size_agrees(spark, monkeypatch):
    names = spark.createDataFrame(
        [("Súper Día",), ("Diario",), ("El Corte Inglés-2",), (None,), ("LIDL,",), ("a b c",)], "name string"
    )
    patterns = spark.createDataFrame([("dia",), ("El Corte Inglés",), ("LIDL",), ("b",)], "pattern string")
    inline = text.with_chain_flag(names, "name", patterns).collect()
    monkeypatch.setattr(text, "MAX_INLINE_PATTERNS", 1)
    joined = text.with_chain_flag(names, "name", patterns).collect()
    assert sorted(map(str, inline)) == sorted(map(str, joined))
    assert sum(r.is_chain for r in joined) == 4


def test_numbers(spark):
    rows = [("41.5",), ("-3",), ("1e3",), (" 41.38 N",), ("abc",), ("+5",), (None,)]
    out = values(spark, "s string", rows, n=text.numeric_or_null(F.col("s")), p=text.leading_number(F.col("s")))
    assert out == [(41.5, 41.5), (-3.0, -3.0), (None, 1000.0), (None, 41.38), (None, None), (None, 5.0), (None, None)]


def test_websites(spark):
    rows = [
        ("www.foo.es", None, "https://www.foo.es/"), ("HTTP://Foo.ES/Path", None, "http://foo.es/Path"),
        ("foo", None, None), ("ftp://a.b", None, None), ("a b.es", None, None), (None, "x.es/y", "https://x.es/y"),
        ("", "x.es", None), ("foo.es:80", None, None), ("https://a.es?q=1", None, "https://a.es/?q=1"),
    ]
    out = [r[0] for r in values(spark, "a string, b string, c string", rows, w=fields.website_url(F.col("a"), F.col("b")))]
    assert out == [r[2] for r in rows]


def test_links(spark):
    rows = [
        ("https://Foo.es:443/a/../b", "https://foo.es/b"), ("http://foo.es:443", "http://foo.es:443/"), ("https://foo.es/ú", "https://foo.es/%C3%BA"),
        ("https://foo.es/{x}/a|b", "https://foo.es/%7Bx%7D/a|b"), ("https://foo.es/[a]", "https://foo.es/[a]"), ("https:\\\\foo.es\\a", "https://foo.es/a"),
        ("https://u:p@foo.es?a b='c'#d e", "https://u:p@foo.es/?a%20b=%27c%27#d%20e"), ("http://foo.es:0080/.", "http://foo.es/"),
        ("https://foo.es/a/b/..", "https://foo.es/a/"), ("https://foo.es/../../x/%2E./y/", "https://foo.es/y/"), ("https://foo.es/a//b", "https://foo.es/a//b"),
        ("https://foo.es/𝄞", "https://foo.es/%F0%9D%84%9E"), (" https://foo.es/a\nb ", "https://foo.es/ab"), ("https://foo.es/%", "https://foo.es/%"),
        ("https://foo.es:70000/", None), ("https://foo.es:x/", None), ("https://a|b.es/", None), ("https://", None), ("mailto:a@b.es", None), ("", None), (None, None),
    ]
    out = values(spark, "s string, w string", rows, c=links.canonical(F.col("s")), o=links.url_origin(F.col("s")), p=links.url_path(F.col("s")))
    assert [r[0] for r in out] == [r[1] for r in rows]
    assert all((r[0] is None) == (r[1] is None) == (r[2] is None) for r in out)
    assert out[1][1:] == ("http://foo.es:443", "/") and out[6][1:] == ("https://foo.es", "/")


def test_addresses_and_names(spark):
    rows = [("GAIARRE", "84", "", "88", "", "GAIARRE 84-88"), ("GAIARRE", "84", "B", "84", "B", "GAIARRE 84B"),
            (" ", "1", "", "", "", None), ("X", "", "", "5", "", "X")]
    cols = [F.col(c) for c in "abcde"]
    out = [r[0] for r in values(spark, "a string, b string, c string, d string, e string, w string", rows, x=fields.bcn_address(*cols))]
    assert out == [r[5] for r in rows]
    rows = [("Ajuntament de Sant Celoni", "Sant Celoni"), ("AJUNTAMENT d'Abrera", "Abrera"), (" ", None)]
    out = [r[0] for r in values(spark, "a string, w string", rows, x=fields.municipality(F.col("a")))]
    assert out == [r[1] for r in rows]


def test_projection_known_point(spark):
    """The central meridian maps to itself, and Puerta del Sol lies where it should."""
    lng, lat = geo.utm30_to_wgs84(F.col("x"), F.col("y"))
    (mid, sol) = values(spark, "x double, y double", [(500000.0, 4649776.0), (440290.0, 4474257.0)], lng=lng, lat=lat)
    assert mid[0] == pytest.approx(-3.0, abs=1e-9)
    assert mid[1] == pytest.approx(42.0, abs=2e-3)
    assert sol == pytest.approx((-3.7036, 40.4167), abs=2e-3)


def test_distance_against_haversine_and_ellipsoid(spark):
    d = geo.distance_m(F.lit(40.0), F.lit(-3.7), F.lit(40.0) + F.col("x"), F.lit(-3.7) + F.col("y"))
    ((north,), (east,)) = values(spark, "x double, y double", [(0.01, 0.0), (0.0, 0.01)], d=d)
    # One hundredth of a degree at 40 degrees north: 1110.35 m north, 853.94 m east.
    assert north == pytest.approx(1110.35, abs=0.2)
    assert east == pytest.approx(853.94, abs=0.2)


def test_mean_point(spark):
    rows = [("[-3.7,40.4]",), ("[[[0,0],[2,0],[2,2],[0,2]]]",), ("[1,2,3]",), ("[]",), ("[[1.5e1, -2],[5,4]]",)]
    lng, lat = geo.geometry_mean_point(F.col("s"))
    assert values(spark, "s string", rows, lng=lng, lat=lat) == [
        (-3.7, 40.4), (1.0, 1.0), (None, None), (None, None), (10.0, 1.0)]


def test_scores_v2(spark):
    cases = [
        # name, codes, status, hours, amenity, shop, chain -> type, score, onsite, takeaway
        ("BAR PEPE", ["561001"], None, None, None, None, False, "bar", 95, True, False),
        ("X", ["471103"], "Baja", None, None, None, False, "otro", 0, False, False),
        ("TIENDA 24H", [], None, "24/7", None, None, False, "tienda_24h", 100, False, True),
        ("PANADERIA LOLA", [], None, None, "cafe", None, False, "otro", 35, False, False),
        ("BARBERIA", [], None, None, None, None, False, "otro", 40, False, False),
        ("NADA", [], None, None, None, None, False, "otro", 0, False, False),
        ("DIA", [], None, None, None, None, True, "supermercado", 85, False, True),
        ("X", [], None, None, None, "wine", False, "bodega", 85, False, True),
    ]
    df = spark.createDataFrame(
        [c[:7] for c in cases],
        "n string, codes array<string>, st string, h string, a string, s string, ch boolean",
    )
    out = classify.with_score_v2(df, *map(F.col, ("n", "codes", "st", "h", "a", "s", "ch")))
    got = [(r.place_type, r.confidence_score, r.sells_onsite_beer, r.sells_takeaway_beer) for r in out.collect()]
    assert got == [c[7:] for c in cases]


def test_scores_v1_first_best_code(spark):
    df = spark.createDataFrame([("BODEGA X", ["471104", "471101"], None, False), ("X", ["999"], None, False),
                                ("X", ["472502"], None, True)],
                               "n string, c array<string>, s string, ch boolean")
    out = classify.with_score_v1(df, F.col("n"), F.col("c"), F.col("s"), F.col("ch")).collect()
    assert [(r.primary_category, r.confidence_score, r.confidence_level) for r in out] == [
        ("alimentacion", 100, "high"), ("otro", 0, "excluded"), ("bodega", 0, "excluded")]


def test_osm_rules(spark):
    tags = [
        ({"amenity": "fuel"}, False), ({"amenity": "fuel", "opening_hours": "24/7"}, True),
        ({"amenity": "fuel", "opening_hours": "24/7", "automated": "yes"}, False),
        ({"amenity": "fuel", "shop": "kiosk"}, True), ({"amenity": "bench"}, False), ({"shop": "alcohol"}, True),
    ]
    out = [r[0] for r in values(spark, "t map<string,string>, w boolean", tags, k=classify.osm_keep(F.col("t")))]
    assert out == [t[1] for t in tags]


def test_diba_words(spark):
    rows = [("Restaurant bar", "bar"), ("Barberia", None), ("Venda de vins", "bodega"), ("Elaboració de vins", None),
            ("Comerç d'alimentació i begudes", "alimentacion"), ("Menjar ràpid", "bar"), ("", None)]
    out = [r[0] for r in values(spark, "s string, w string", rows, t=classify.diba_type(F.col("s")))]
    assert out == [r[1] for r in rows]


def test_log_coordinates(spark):
    rows = [("/api/stores/nearby?lat=1&lng=2&lat=3",), ("/api/stores/map?north=2&south=0&east=4&west=2",),
            ("/api/stores/map?north=2&south=0",), ("/api/meta?lat=1&lng=2",)]
    df = spark.createDataFrame(rows, "uri string")
    assert [(r.lat, r.lng) for r in traffic.located_requests(df).collect()] == [(3.0, 2.0), (1.0, 3.0)]


def test_metro_catchment(spark):
    df = spark.createDataFrame([(40.45, -3.7), (40.0, -1.0), (41.65, -4.7)], "lat double, lng double")
    assert [r.area for r in traffic.with_metro(df).collect()] == ["Madrid", "Otras zonas", "Valladolid"]


def test_parameters(spark):
    df = spark.createDataFrame(
        [(40.0, -3.0, None, None, None), (91.0, 0.0, 0, 201, "x"), (0.0, 0.0, 5000, 200, "2026-01-01T00:00:00")],
        "lat double, lng double, radius_m int, limit int, at_time_text string",
    )
    rows = serve.check_parameters(df).collect()
    assert [r.rejected for r in rows] == ["", "lat,radius_m,limit,at_time", ""]
    assert (rows[0].radius_m, rows[0].limit) == (1000, 50)


def test_haversine(spark):
    ((km,),) = values(spark, "x int", [(1,)], d=geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.lit(41.3874), F.lit(2.1686)))
    assert math.isclose(km, 505.4, abs_tol=1.0)

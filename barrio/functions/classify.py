"""Deterministic classification and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.text import activity_text, contains_any, fold_upper

# Place types, base scores and labels.
BASE_SCORE = {
    "tienda_24h": 95, "bar": 90, "supermercado": 85, "bodega": 85, "alimentacion": 75, "otro": 35,
}
TAKEAWAY_TYPES = ["supermercado", "alimentacion", "bodega", "tienda_24h"]
SCORING_V2 = "v2-beer"
SCORING_V1 = "v1-deterministic"

# Name hints of the current scorer, tested as substrings.
HINT_BAR = ["BAR", "TABERNA", "CERVEZA", "CERVECERIA", "PUB", "IRLANDES"]
HINT_24H = ["24H", "24 HORAS"]
HINT_BODEGA = ["BODEGA", "VINOS"]
HINT_SHOP = ["ALIMENTACION", "MINI MARKET", "MINIMARKET", "ULTRAMARINOS"]
HINT_NOT_BAR = ["CONFITERIA", "HELADERIA", "PANADERIA", "PASTELERIA"]

# Words in an official status that mean closed.
CLOSED_WORDS = ["BAJA", "CERRADO", "INACTIVO", "ANULAD", "USO VIVIENDA"]
CLOSED_WORDS_V1 = ["BAJA", "CERRADO", "INACTIVO", "ANULAD"]

# Activity codes of the Madrid register.
BAR_CODES = ["561001", "561002", "561004", "561005"]
FOOD_CODES = ["471101", "471104", "472911", "472501"]
CODE_SCORE_V1 = {
    "471103": 100, "471101": 90, "471104": 90, "472911": 80, "472502": 65, "472907": 55,
    "472908": 55, "472909": 55, "472501": 45,
}
CODE_CATEGORY_V1 = {
    "471103": "conveniencia", "471101": "alimentacion", "471104": "alimentacion",
    "472911": "alimentacion", "472502": "bodega", "472907": "snacks", "472908": "snacks",
    "472909": "snacks", "472501": "alimentacion",
}
TARGET_CODES = [*CODE_SCORE_V1, *BAR_CODES]
HINT_STRONG_V1 = [
    "ALIMENTACION", "MINI MARKET", "MINIMARKET", "24H", "24 HORAS", "ULTRAMARINOS", "BODEGA",
]
HINT_ADJACENT_V1 = ["BEBIDAS", "FRUTOS SECOS", "APERITIVOS", "SNACKS"]

# Map tags of interest.
OSM_AMENITIES = ["bar", "pub", "cafe", "restaurant", "fast_food"]
OSM_SHOPS = ["convenience", "alcohol", "supermarket", "general", "kiosk"]
OSM_TAKEAWAY_SHOPS = ["alcohol", "convenience", "supermarket", "general", "kiosk", "wine"]

# Activity codes of the Barcelona city and Andalucía registers.
BCN_TYPES = {
    "1400001": "bar", "1400002": "bar", "1400003": "bar", "1400000": "bar",
    "1000020": "supermercado", "1001000": "bodega", "1000030": "alimentacion",
    "1000000": "alimentacion",
}
CNAE_TYPES = {
    "5630": "bar", "5610": "bar", "4711": "supermercado", "4725": "bodega",
    "4721": "alimentacion", "4722": "alimentacion", "4723": "alimentacion",
    "4724": "alimentacion", "4729": "alimentacion",
}

# Catalan activity words of the Barcelona province register.
DIBA_BAR = [
    "BAR", "RESTAURANT", "RESTAURANTS", "CAFETERIA", "CAFE", "CAFES", "PIZZERIA", "CERVESERIA",
    "TAVERNA", "HAMBURGUESERIA", "CREPERIA", "BRASSERIA", "ENTREPANS",
]
DIBA_BAR_TEXT = ["ESTABLIMENTS DE MENJAR", "MENJAR RAPID", "MENJAR PER EMPORTAR"]
DIBA_SUPER = ["SUPERMERCAT", "HIPERMERCAT", "AUTOSERVEI"]
DIBA_DRINKS = ["BEGUDES", "CELLER", "VINOTECA", "VINS", "CAVES"]
DIBA_DRINKS_VETO = ["ALIMENT", "ELABORACIO", "CONREU", "FABRICACIO"]
DIBA_FOOD = [
    "ALIMENTACIO", "ALIMENTARIS", "ALIMENTS", "QUEVIURES", "COLMADO", "CARNISSERIA", "CARN",
    "CANSALADERIA", "XARCUTERIA", "PEIXATERIA", "PEIX", "FRUITERIA", "FRUITA", "FRUITES",
    "VERDURES", "FORN", "FLECA", "PASTISSERIA", "CONFITERIA", "ROSTISSERIA", "FORMATGES",
]
DIBA_FOOD_TEXT = ["PRODUCTES ALIMENTARIS"]

SCORING_BCN = "censo-bcn-v1"
SCORING_DIBA = "censo-diba-v1"
SCORING_ANDALUCIA = "censo-andalucia-v1"
SCORING_OSM = "osm-v1"


def lookup(values: dict, key: Column) -> Column:
    """A fixed table as an expression; null for unknown keys."""
    groups: dict = {}
    for code, value in values.items():
        groups.setdefault(value, []).append(code)
    out = F.lit(None)
    for value, codes in groups.items():
        out = F.when(key.isin(codes), F.lit(value)).otherwise(out)
    return out


def types_compatible(a: Column, b: Column) -> Column:
    """Same type, or both sell to take away."""
    return (a == b) | (a.isin(TAKEAWAY_TYPES) & b.isin(TAKEAWAY_TYPES))


def type_class(place_type: Column) -> Column:
    """Key shared by exactly the compatible types."""
    return F.when(place_type.isin(TAKEAWAY_TYPES), F.lit("takeaway")).otherwise(place_type)


def officially_closed(status: Column, words: list[str] = CLOSED_WORDS) -> Column:
    """The folded status mentions closure."""
    return contains_any(fold_upper(status), words)


def clamp_score(score: Column) -> Column:
    """Score limited to 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def level_from_score(score: Column) -> Column:
    """Confidence bucket of a score."""
    return (
        F.when(score >= 80, "high").when(score >= 55, "medium").when(score >= 30, "low")
        .otherwise("excluded")
    )


def is_target_code(code: Column) -> Column:
    """Activity code of interest."""
    return code.isin(TARGET_CODES)


def _tag(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def _badges(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def census_badges(place_type: Column, takeaway: Column, onsite: Column) -> Column:
    """Badges of a register row, which never has opening hours."""
    return _badges(
        place_type,
        F.when(takeaway, F.lit("vende_cerveza_para_llevar")),
        F.when(onsite, F.lit("vende_cerveza_in_situ")),
        F.lit("horario_no_confirmado"),
    )


def with_score_v2(
    df: DataFrame, name: Column, codes: Column, status: Column, hours: Column, amenity: Column,
    shop: Column, is_chain: Column,
) -> DataFrame:
    """Add type, sale flags, score, level, badges and version of the current scorer.

    `codes` is an array; `hours`, `amenity` and `shop` may be null. Intermediate results are
    columns of their own, so that each is computed once and the stage stays one generated loop.
    """
    step = df.select(
        "*",
        fold_upper(name).alias("_name"),
        F.coalesce(codes, F.array().cast("array<string>")).alias("_codes"),
        officially_closed(status).alias("_closed"),
        F.trim(F.coalesce(hours, F.lit(""))).alias("_hours"),
        _tag(amenity).alias("_amenity"),
        _tag(shop).alias("_shop"),
        is_chain.alias("_chain"),
    )
    folded = F.col("_name")
    step = step.select(
        "*",
        contains_any(folded, HINT_BAR).alias("_bar"),
        contains_any(folded, HINT_24H).alias("_24h"),
        contains_any(folded, HINT_BODEGA).alias("_bodega"),
        contains_any(folded, HINT_SHOP).alias("_food"),
        contains_any(folded, HINT_NOT_BAR).alias("_not_bar"),
    )
    has_code = lambda wanted: F.arrays_overlap("_codes", F.array(*map(F.lit, wanted)))
    tag_a, tag_s = F.col("_amenity"), F.col("_shop")
    step = step.withColumn(
        "_type",
        F.when(tag_a.isin("bar", "pub"), "bar")
        .when(tag_s.isin("alcohol", "wine"), "bodega")
        .when(tag_s == "supermarket", "supermercado")
        .when(has_code(BAR_CODES), "bar")
        .when(tag_a.isin("cafe", "restaurant") & ~F.col("_not_bar"), "bar")
        .when(F.col("_chain"), "supermercado")
        .when(has_code(["471103"]) | F.col("_24h"), "tienda_24h")
        .when(has_code(["472502"]) | F.col("_bodega"), "bodega")
        .when(has_code(FOOD_CODES) | F.col("_food"), "alimentacion")
        .otherwise("otro"),
    )
    points = lambda test, n: F.when(test, n).otherwise(0)
    kind = F.col("_type")
    named = F.col("_bar") | F.col("_24h") | F.col("_bodega") | F.col("_food")
    raw = (
        lookup(BASE_SCORE, kind)
        + points(F.col("_hours") != "", 15)
        + points(F.col("_hours") == "24/7", 10)
        + points(F.col("_bar"), 5)
        + points(F.col("_24h"), 5)
        + points(F.col("_bodega"), 5)
        + points(F.col("_food"), 5)
        + points(tag_s.isin("convenience", "alcohol", "supermarket"), 5)
        + points(tag_a.isin("bar", "pub"), 5)
        - points((kind == "otro") & ~(named | (tag_s != "") | (tag_a != "")), 100)
    )
    takeaway = (
        kind.isin(TAKEAWAY_TYPES) | F.col("_bodega") | F.col("_food")
        | folded.contains("CERVEZA") | tag_s.isin(OSM_TAKEAWAY_SHOPS)
    )
    onsite = (kind == "bar") | (tag_a.isin(OSM_AMENITIES) & ~F.col("_not_bar"))
    is_open = ~F.col("_closed")
    step = step.select(
        "*",
        F.when(is_open, clamp_score(raw)).otherwise(0).cast("int").alias("confidence_score"),
        F.when(is_open, kind).otherwise("otro").alias("place_type"),
        (is_open & takeaway).alias("sells_takeaway_beer"),
        (is_open & onsite).alias("sells_onsite_beer"),
    )
    badges = F.when(
        is_open,
        _badges(
            F.when(kind != "otro", kind),
            F.when(F.col("sells_takeaway_beer"), F.lit("vende_cerveza_para_llevar")),
            F.when(F.col("sells_onsite_beer"), F.lit("vende_cerveza_in_situ")),
            F.when(F.col("_hours") == "", F.lit("horario_no_confirmado")),
        ),
    ).otherwise(F.array(F.lit("posible_cerrado"), F.lit("horario_no_confirmado")))
    return step.select(
        "*",
        level_from_score(F.col("confidence_score")).alias("confidence_level"),
        badges.alias("badges"),
        F.lit(SCORING_V2).alias("scoring_version"),
    ).drop(
        "_name", "_codes", "_closed", "_hours", "_amenity", "_shop", "_chain", "_bar", "_24h",
        "_bodega", "_food", "_not_bar", "_type",
    )


def with_score_v1(
    df: DataFrame, name: Column, codes: Column, status: Column, is_chain: Column
) -> DataFrame:
    """Add the legacy score, category, level and badges. `codes` is an ordered array."""
    step = df.select(
        "*",
        fold_upper(name).alias("_name"),
        F.coalesce(codes, F.array().cast("array<string>")).alias("_codes"),
        officially_closed(status, CLOSED_WORDS_V1).alias("_closed"),
        is_chain.alias("_chain"),
    )
    scored = F.transform("_codes", lambda c: F.coalesce(lookup(CODE_SCORE_V1, c), F.lit(0)))
    step = step.withColumn("_scores", scored)
    step = step.withColumn("_base", F.coalesce(F.array_max("_scores"), F.lit(0)))
    # The first code reaching the maximum decides the category.
    step = step.withColumn(
        "_best", F.get("_codes", (F.array_position("_scores", F.col("_base")) - 1).cast("int"))
    )
    folded, base = F.col("_name"), F.col("_base")
    points = lambda test, n: F.when(test, n).otherwise(0)
    raw = (
        base
        + points(contains_any(folded, HINT_STRONG_V1), 20)
        + points(contains_any(folded, HINT_ADJACENT_V1), 10)
        - points(F.col("_chain"), 80)
        - points(base == 0, 50)
    )
    step = step.select(
        "*",
        F.when(folded.contains("ULTRAMARINOS"), "ultramarinos")
        .otherwise(F.coalesce(lookup(CODE_CATEGORY_V1, F.col("_best")), F.lit("otro")))
        .alias("primary_category"),
        F.when(F.col("_closed"), 0).otherwise(clamp_score(raw)).cast("int").alias("confidence_score"),
    )
    category = F.col("primary_category")
    has = lambda *wanted: F.arrays_overlap("_codes", F.array(*map(F.lit, wanted)))
    snacks = [code for code, kind in CODE_CATEGORY_V1.items() if kind == "snacks"]
    badges = F.when(
        F.col("_closed"), F.array(F.lit("posible_cerrado"), F.lit("horario_no_confirmado"))
    ).otherwise(
        _badges(
            F.when(category.isin("alimentacion", "ultramarinos"), F.lit("alimentacion")),
            F.when((category == "conveniencia") | has("471103"), F.lit("conveniencia")),
            F.when(category == "bodega", F.lit("bodega")),
            F.when((category == "snacks") | has(*snacks), F.lit("snacks")),
            F.when(has("472502", "472501") | folded.contains("BEBIDAS"), F.lit("bebidas")),
            F.when(contains_any(folded, HINT_24H), F.lit("24h")),
            F.lit("horario_no_confirmado"),
        )
    )
    level = F.when(F.col("_closed") | F.col("_chain"), "excluded").otherwise(
        level_from_score(F.col("confidence_score"))
    )
    return step.select(
        "*", level.alias("confidence_level"), badges.alias("badges"),
        F.lit(SCORING_V1).alias("scoring_version"),
    ).drop("_name", "_codes", "_closed", "_chain", "_scores", "_base", "_best")


def classify_osm(amenity: Column, shop: Column, hours: Column) -> Column:
    """Type and sale flags from map tags."""
    is_bar = F.coalesce(amenity.isin(OSM_AMENITIES), F.lit(False))
    always = F.coalesce(hours.contains("24/7"), F.lit(False))
    place_type = (
        F.when(is_bar, "bar")
        .when(amenity == "fuel", "gasolinera")
        .when(shop == "supermarket", "supermercado")
        .when(shop == "alcohol", "bodega")
        .when((shop == "convenience") & always, "tienda_24h")
        .when(shop.isin("convenience", "general", "kiosk"), "alimentacion")
        .otherwise("otro")
    )
    return F.struct(
        place_type.alias("place_type"),
        (place_type == "bar").alias("sells_onsite_beer"),
        (~place_type.isin("bar", "otro")).alias("sells_takeaway_beer"),
    )


def osm_keep(tags: Column) -> Column:
    """Features worth keeping: known amenity or shop, or an attended fuel station with hours."""
    tag = lambda key: F.try_element_at(tags, F.lit(key))
    attended = (
        (tag("amenity") == "fuel")
        & tag("opening_hours").isNotNull()
        & F.coalesce(tag("automated") != "yes", F.lit(True))
        & F.coalesce(tag("self_service") != "yes", F.lit(True))
    )
    return (
        F.coalesce(tag("amenity").isin(OSM_AMENITIES), F.lit(False))
        | F.coalesce(tag("shop").isin(OSM_SHOPS), F.lit(False))
        | F.coalesce(attended, F.lit(False))
    )


def osm_score(hours: Column, brand: Column, brand_id: Column) -> Column:
    """Score and level from the presence of hours; chain flag from brand tags."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.struct(
        F.when(filled(hours), 80).otherwise(55).alias("confidence_score"),
        F.when(filled(hours), "high").otherwise("medium").alias("confidence_level"),
        (filled(brand) | filled(brand_id)).alias("is_chain"),
    )


def _census_class(place_type: Column, onsite: Column, version: str) -> Column:
    """Common tail of the register classifiers; null where the type is null."""
    score = lookup(BASE_SCORE, place_type)
    takeaway = place_type != "bar"
    return F.when(
        place_type.isNotNull(),
        F.struct(
            place_type.alias("place_type"),
            onsite.alias("sells_onsite_beer"),
            takeaway.alias("sells_takeaway_beer"),
            score.cast("int").alias("confidence_score"),
            level_from_score(score).alias("confidence_level"),
            census_badges(place_type, takeaway, onsite).alias("badges"),
            F.lit(version).alias("scoring_version"),
        ),
    )


def classify_bcn(code: Column, open_24h: Column, tasting: Column) -> Column:
    """Barcelona city rows by activity code; null for other activities."""
    mapped = lookup(BCN_TYPES, code)
    place_type = F.when(open_24h & (mapped != "bar"), "tienda_24h").otherwise(mapped)
    return _census_class(place_type, (place_type == "bar") | tasting, SCORING_BCN)


def classify_andalucia(cnae: Column) -> Column:
    """Andalucía rows by economic activity code; null for other activities."""
    place_type = lookup(CNAE_TYPES, F.trim(cnae))
    return _census_class(place_type, place_type == "bar", SCORING_ANDALUCIA)


def diba_type(description: Column) -> Column:
    """Type from a free Catalan activity text by whole words; null if not of interest."""
    text = activity_text(description)
    words = F.split(text, " ")
    word = lambda wanted: F.arrays_overlap(words, F.array(*map(F.lit, wanted)))
    return (
        F.when(word(DIBA_BAR) | contains_any(text, DIBA_BAR_TEXT), "bar")
        .when(word(DIBA_SUPER), "supermercado")
        .when(word(DIBA_DRINKS) & ~contains_any(text, DIBA_DRINKS_VETO), "bodega")
        .when(word(DIBA_FOOD) | contains_any(text, DIBA_FOOD_TEXT), "alimentacion")
    )


def classify_diba(description: Column) -> Column:
    """Barcelona province rows by activity text; null for other activities."""
    place_type = diba_type(description)
    return _census_class(place_type, place_type == "bar", SCORING_DIBA)


def legacy_place_type(is_chain: Column, category: Column) -> Column:
    """Type and flags of rows that only carry the legacy category."""
    shops = ["conveniencia", "alimentacion", "ultramarinos", "bodega"]
    place_type = (
        F.when(is_chain, "supermercado")
        .when(category == "conveniencia", "tienda_24h")
        .when(category.isin("alimentacion", "ultramarinos"), "alimentacion")
        .when(category == "bodega", "bodega")
        .otherwise("otro")
    )
    return F.struct(
        place_type.alias("place_type"),
        (is_chain | F.coalesce(category.isin(shops), F.lit(False))).alias("sells_takeaway_beer"),
        F.lit(False).alias("sells_onsite_beer"),
    )

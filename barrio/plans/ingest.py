"""From scanned source rows to a batch of place rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.classify import (
    classify_andalucia, classify_bcn, classify_diba, classify_osm, osm_keep, osm_score, with_score_v2,
)
from barrio.functions.fields import bcn_address, display_name, municipality
from barrio.functions.geo import BOXES, in_box, utm30_to_wgs84
from barrio.functions.text import blank_to_null, leading_number, match_name, with_chain_flag
from barrio.operators.census import madrid_candidates
from barrio.session import spread
from barrio.sources.scans import OSM_KINDS, osm_places

CLASS_FIELDS = [
    "place_type", "sells_onsite_beer", "sells_takeaway_beer", "confidence_score",
    "confidence_level", "badges", "scoring_version",
]


def _classified(rows: DataFrame, label: Column, box: str, **fields: Column) -> DataFrame:
    """Keep classified rows inside the source's box and lay out the place fields."""
    return (
        rows.where("_c is not null").where(in_box(F.col("lat"), F.col("lng"), BOXES[box]))
        .withColumn("_label", label)
        .select(
            *[column.alias(name) for name, column in fields.items()],
            F.col("_label").alias("name"), match_name(F.col("_label")).alias("normalized_name"),
            "lat", "lng", "_c.*", "is_chain",
        )
    )


def barcelona_batch(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Barcelona city register rows of interest."""
    yes = lambda c: F.coalesce(F.col(c) == "Si", F.lit(False))
    rows = (
        with_chain_flag(spread(rows), "Nom_Local", patterns)
        .withColumn("_c", classify_bcn(F.col("Codi_Activitat_2022"), yes("SN_Obert24h"), yes("SN_Servei_Degustacio")))
        .withColumn("lat", leading_number(F.col("Latitud"))).withColumn("lng", leading_number(F.col("Longitud")))
    )
    address = bcn_address(*map(F.col, (
        "Nom_Via", "Num_Policia_Inicial", "Lletra_Inicial", "Num_Policia_Final", "Lletra_Final")))
    return _classified(
        rows, display_name(F.col("Nom_Local"), F.col("Nom_Activitat"), "SN"), "barcelona",
        source_local_id=F.col("ID_Global"), address=address,
        district=blank_to_null(F.col("Nom_Districte")), neighbourhood=blank_to_null(F.col("Nom_Barri")),
    )


def diba_batch(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Barcelona province register rows of interest."""
    rows = (
        with_chain_flag(spread(rows), "nom_comercial", patterns)
        .withColumn("_c", classify_diba(F.col("descripcio_activitat")))
        .withColumn("lat", leading_number(F.col("latitud"))).withColumn("lng", leading_number(F.col("longitud")))
    )
    return _classified(
        rows, display_name(F.col("nom_comercial"), F.col("descripcio_activitat")), "diba",
        source_local_id=F.concat_ws("-", "codi_ens", "identificador"),
        address=blank_to_null(F.col("adreca_complerta")), district=municipality(F.col("nom_ens")),
    )


def andalucia_batch(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Andalucía directory rows of interest."""
    rows = with_chain_flag(spread(rows), "razon_social", patterns).withColumn("_c", classify_andalucia(F.col("cnae")))
    return _classified(
        rows, display_name(F.col("razon_social"), F.col("actividad")), "andalucia",
        source_local_id=F.col("id"), address=blank_to_null(F.col("domicilio")),
        district=blank_to_null(F.col("nombre_mun")),
    )


def _scored(rows: DataFrame, patterns: DataFrame, name: str, codes: Column, status: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return with_score_v2(
        with_chain_flag(rows, name, patterns), F.col(name), codes, F.col(status), none, none, none,
        F.col("is_chain"),
    )


def madrid_batch(rows: DataFrame, patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """Madrid register premises of interest, with their activities."""
    scored = _scored(madrid_candidates(rows, limit), patterns, "rotulo", F.col("codes"), "official_status")
    lng, lat = utm30_to_wgs84(F.col("x"), F.col("y"))
    label = F.coalesce("rotulo", F.lit(""))
    return scored.select(
        F.col("id_local").alias("source_local_id"), label.alias("name"),
        match_name(label).alias("normalized_name"), blank_to_null(F.col("address")).alias("address"),
        F.lit(None).cast("string").alias("postal_code"),
        F.nullif("district", F.lit("")).alias("district"), F.nullif("neighbourhood", F.lit("")).alias("neighbourhood"),
        lat.alias("lat"), lng.alias("lng"), *CLASS_FIELDS, "is_chain", "official_status", "activities",
    )


def sample_batch(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Development fixture rows."""
    scored = _scored(rows, patterns, "name", F.array("epigraph_code"), "official_status")
    lng, lat = utm30_to_wgs84(F.col("x"), F.col("y"))
    return scored.select(
        "source_local_id", "name", match_name(F.col("name")).alias("normalized_name"), "address",
        "postal_code", "district", "neighbourhood", lat.alias("lat"), lng.alias("lng"), *CLASS_FIELDS,
        "is_chain", "official_status",
        F.array(F.struct(F.col("epigraph_code").alias("code"), F.col("epigraph_description").alias("description"))).alias("activities"),
    )


def osm_kind(local_id: Column) -> Column:
    """Map object kind from the id prefix."""
    out = F.lit("node")
    for prefix, kind in OSM_KINDS.items():
        out = F.when(local_id.startswith(prefix), kind).otherwise(out)
    return out


def osm_batch(features: DataFrame, filtered: bool = True) -> DataFrame:
    """Canonical rows from map features or elements (id, tags and a position)."""
    features = spread(features)
    kept = features.where(osm_keep(F.col("tags"))) if filtered else features
    places = osm_places(kept)
    return (
        places.withColumn("_c", classify_osm(F.col("amenity"), F.col("shop"), F.col("opening_hours")))
        .withColumn("_s", osm_score(F.col("opening_hours"), F.col("brand"), F.col("brand_id")))
        .select(
            "source_local_id", F.coalesce("name", F.lit("")).alias("name"), "normalized_name", "address",
            "lat", "lng", "_c.*", F.col("opening_hours").alias("opening_hours_osm"), "website", "_s.*",
        )
    )

"""Madrid register: candidates per premises, activities, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrio.functions.classify import TARGET_CODES, is_target_code
from barrio.functions.fields import madrid_address
from barrio.functions.geo import in_madrid_utm
from barrio.functions.text import numeric_or_null

# Street access and open status.
STREET_ACCESS = "1"
STATUS_OPEN = "1"


def madrid_candidates(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per open street-level premises with an activity of interest.

    Grouping first by premises and activity keeps even a premises with very many rows spread
    over tasks; the second grouping sees each activity of a premises once.
    """
    x, y = numeric_or_null(F.col("coordenada_x_local")), numeric_or_null(F.col("coordenada_y_local"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    address = madrid_address(*map(F.col, ("clase_vial_edificio", "desc_vial_edificio", "num_edificio", "cal_edificio")))
    kept = rows.where(
        (F.col("id_tipo_acceso_local") == STREET_ACCESS)
        & (F.col("id_situacion_local") == STATUS_OPEN)
        & (F.col("id_local") != "")
        & in_madrid_utm(x, y)
    ).select(
        "id_local", "rotulo",
        F.col("desc_distrito_local").alias("district"),
        F.col("desc_barrio_local").alias("neighbourhood"),
        address.alias("address"), x.alias("x"), y.alias("y"),
        F.col("desc_situacion_local").alias("official_status"),
        blank("id_epigrafe").alias("code"), blank("desc_epigrafe").alias("description"),
    )
    facts = ["rotulo", "district", "neighbourhood", "address", "x", "y", "official_status"]
    per_code = kept.groupBy("id_local", "code").agg(
        F.max("description").alias("description"), *[F.max(c).alias(c) for c in facts]
    )
    activity = F.when(F.col("code").isNotNull(), F.struct("code", "description"))
    out = (
        per_code.groupBy("id_local")
        .agg(F.array_sort(F.collect_list(activity)).alias("activities"), *[F.max(c).alias(c) for c in facts])
        .withColumn("codes", F.col("activities.code"))
        .where(F.arrays_overlap("codes", F.array(*map(F.lit, TARGET_CODES))))
    )
    return out.orderBy("id_local").limit(limit) if limit else out


def activities(candidates: DataFrame, key: str = "id_local") -> DataFrame:
    """One row per premises and activity, flagged when of interest."""
    return candidates.select(key, F.explode("activities").alias("a")).select(
        key,
        F.col("a.code").alias("epigraph_code"),
        F.col("a.description").alias("epigraph_description"),
        is_target_code(F.col("a.code")).alias("is_target_epigraph"),
    )


def code_counts(rows: DataFrame, code: str, label: str) -> DataFrame:
    """Rows per code with one of its labels."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.groupBy(text(code).alias("code")).agg(
        F.min(text(label)).alias("label"), F.count(F.lit(1)).alias("n")
    )


def source_profile(rows: DataFrame, declared: list[str]) -> DataFrame:
    """Size, coordinate quality and column drift of a raw table as (metric, value) rows."""
    x, y = F.col("coordenada_x_local"), F.col("coordenada_y_local")
    given = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    drift = {
        "missing_columns": sorted(set(declared) - set(rows.columns)),
        "unexpected_columns": sorted(set(rows.columns) - set(declared)),
    }
    totals = rows.agg(
        F.count(F.lit(1)).cast("string").alias("rows"),
        F.count_if(given).cast("string").alias("rows_with_coords"),
        F.count_if(given & in_madrid_utm(x.try_cast("double"), y.try_cast("double")))
        .cast("string").alias("rows_with_valid_coords"),
    )
    for name, columns in drift.items():
        totals = totals.withColumn(name, F.lit(",".join(columns)))
    totals = totals.withColumn("column_count", F.lit(str(len(rows.columns))))
    return totals.unpivot([], totals.columns, "metric", "value")


def sample_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    """Some raw rows to look at."""
    return rows.limit(n)

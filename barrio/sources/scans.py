"""Readers of the place sources. All fields arrive as text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrio.functions.fields import osm_address, website_url
from barrio.functions.geo import geometry_mean_point
from barrio.functions.text import match_name

# Columns of the Madrid activities file.
MADRID_COLUMNS = [
    "id_local", "id_distrito_local", "desc_distrito_local", "id_barrio_local", "desc_barrio_local",
    "cod_barrio_local", "id_seccion_censal_local", "desc_seccion_censal_local",
    "coordenada_x_local", "coordenada_y_local", "id_tipo_acceso_local", "desc_tipo_acceso_local",
    "id_situacion_local", "desc_situacion_local", "id_vial_edificio", "clase_vial_edificio",
    "desc_vial_edificio", "id_ndp_edificio", "id_clase_ndp_edificio", "nom_edificio",
    "num_edificio", "cal_edificio", "secuencial_local_PC", "id_vial_acceso", "clase_vial_acceso",
    "desc_vial_acceso", "id_ndp_acceso", "id_clase_ndp_acceso", "nom_acceso", "num_acceso",
    "cal_acceso", "coordenada_x_agrupacion", "coordenada_y_agrupacion", "id_agrupacion",
    "nombre_agrupacion", "id_tipo_agrup", "desc_tipo_agrup", "id_planta_agrupado",
    "id_local_agrupado", "rotulo", "id_seccion", "desc_seccion", "id_division", "desc_division",
    "id_epigrafe", "desc_epigrafe", "fx_carga",
]

# Columns read from the Barcelona city file.
BCN_COLUMNS = [
    "ID_Global", "Codi_Activitat_2022", "Nom_Activitat", "Nom_Local", "SN_Obert24h",
    "SN_Servei_Degustacio", "Latitud", "Longitud", "Nom_Via", "Num_Policia_Inicial",
    "Lletra_Inicial", "Num_Policia_Final", "Lletra_Final", "Nom_Barri", "Nom_Districte",
]

# Columns read from the Barcelona province file.
DIBA_COLUMNS = [
    "codi_ens", "nom_ens", "identificador", "descripcio_activitat", "nom_comercial",
    "adreca_complerta", "sector_economic", "latitud", "longitud",
]

# Properties read from the Andalucía layer.
ANDALUCIA_PROPERTIES = [
    "id", "razon_social", "domicilio", "codpos", "provincia", "codmun", "nombre_mun", "cnae",
    "actividad", "sector_actividad",
]

# Columns of the development fixture.
SAMPLE_COLUMNS = [
    "source_local_id", "name", "address", "postal_code", "district", "neighbourhood", "x_25830",
    "y_25830", "epigraph_code", "epigraph_description", "official_status",
]

OSM_KINDS = {"n": "node", "w": "way", "a": "way", "r": "relation"}


def _csv(spark: SparkSession, path: str, columns: list[str] | None, sep: str, multi_line: bool,
         trim: bool = False) -> DataFrame:
    """Delimited text by header name; a declared column that is absent becomes null.

    `multi_line` allows line breaks inside quotes but keeps a file in one task; switch it off
    for large files without them and they are split.
    """
    df = spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, multiLine=multi_line, encoding="UTF-8",
        quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=trim,
        ignoreTrailingWhiteSpace=trim,
    )
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    if columns is None:
        return df
    present = set(df.columns)
    return df.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns]
    )


def scan_madrid(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Madrid activities file: semicolons, optional byte-order mark, empty as null."""
    return _csv(spark, path, MADRID_COLUMNS, ";", multi_line)


def scan_madrid_raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The same file with whatever columns it has, for drift checks."""
    return _csv(spark, path, None, ";", multi_line)


def scan_barcelona(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Barcelona city file."""
    return _csv(spark, path, BCN_COLUMNS, ",", multi_line)


def scan_diba(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Barcelona province file."""
    return _csv(spark, path, DIBA_COLUMNS, ",", multi_line)


def scan_andalucia(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON feature collections, one row per feature; a null geometry gives null lat/lng."""
    properties = ", ".join(f"{p}: string" for p in ANDALUCIA_PROPERTIES)
    schema = (
        "features array<struct<geometry: struct<type: string, coordinates: array<double>>, "
        f"properties: struct<{properties}>>>"
    )
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = lambda i: F.get(F.col("f.geometry.coordinates"), F.lit(i))
    return features.select("f.properties.*", at(0).alias("lng"), at(1).alias("lat"))


def scan_osm_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON text sequence: (id, coordinates text, tags). Bad and blank lines are dropped."""
    schema = "id string, geometry struct<type: string, coordinates: string>, properties map<string,string>"
    line = F.trim(F.regexp_replace("value", "^\x1e", ""))
    return (
        spark.read.text(path).select(F.from_json(line, schema).alias("f"))
        .where("f.geometry.coordinates is not null")
        .select(
            F.coalesce("f.id", F.lit("")).alias("id"),
            F.col("f.geometry.coordinates").alias("coordinates"),
            F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("tags"),
        )
    )


def osm_places(features: DataFrame) -> DataFrame:
    """Place fields of features or elements with `tags`; needs lat/lng or coordinates."""
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    if "lat" not in features.columns:
        lng, lat = geometry_mean_point(F.col("coordinates"))
        features = features.withColumn("lng", lng).withColumn("lat", lat).where("lat is not null")
    return features.select(
        F.col("id").alias("source_local_id"), "lat", "lng",
        tag("name").alias("name"),
        match_name(tag("name")).alias("normalized_name"),
        osm_address(tag("addr:street"), tag("addr:housenumber")).alias("address"),
        tag("opening_hours").alias("opening_hours"),
        tag("shop").alias("shop"), tag("amenity").alias("amenity"),
        website_url(tag("website"), tag("contact:website")).alias("website"),
        tag("brand").alias("brand"), tag("brand:wikidata").alias("brand_id"),
        "tags",
    )


def scan_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Map query response: elements with a position and a shop or amenity tag."""
    schema = (
        "elements array<struct<type: string, id: bigint, lat: double, lon: double, "
        "center: struct<lat: double, lon: double>, tags: map<string,string>>>"
    )
    element = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    has = lambda key: F.coalesce(F.try_element_at("e.tags", F.lit(key)), F.lit("")) != ""
    return element.where(has("shop") | has("amenity")).select(
        F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("id"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"),
        F.coalesce("e.lon", "e.center.lon").alias("lng"),
        F.col("e.tags").alias("tags"),
    ).where("lat is not null and lng is not null")


def scan_sample(spark: SparkSession, path: str) -> DataFrame:
    """Development fixture, trimmed; a coordinate that is not a number fails the run."""
    df = _csv(spark, path, SAMPLE_COLUMNS, ",", True, trim=True)
    x, y = F.col("x_25830").try_cast("double"), F.col("y_25830").try_cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    guard = lambda c: F.when(finite(x) & finite(y), c).otherwise(
        F.raise_error(F.concat(F.lit("invalid coordinates for "), F.col("source_local_id"))).cast("double")
    )
    return df.withColumn("x", guard(x)).withColumn("y", guard(y))


def scan_access_log(spark: SparkSession, folder: str, files: str = "{access.log,access-*.log*}") -> DataFrame:
    """JSON log lines of a base file and its rolled siblings, plain or gzip; bad lines dropped.

    Files are matched by name inside the folder, so none is read twice. `ts_epoch` is set for
    numeric times, `ts_text` otherwise.
    """
    schema = (
        "ts string, request struct<uri: string, remote_ip: string, client_ip: string, remote_addr: string>"
    )
    lines = spark.read.option("pathGlobFilter", files).text(folder)
    entry = lines.select(F.from_json("value", schema).alias("e")).where("e.request.uri is not null")
    epoch = F.when(F.col("e.ts").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("e.ts").try_cast("double"))
    return entry.select(epoch.alias("ts_epoch"), F.col("e.ts").alias("ts_text"), "e.request.*")


def scan_chain_patterns(patterns: DataFrame) -> DataFrame:
    """Enabled chain name patterns."""
    return patterns.where("enabled").select("pattern")


# Larger files are streamed; the name endings are those that Hadoop's text reader would unpack.
WHOLE_BYTES = 64 << 20
_UNPACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|xz|Z)$"

_DIGEST = "path string, sha256 string, length long"


def _line_hasher():
    """The task that hashes files whose lines come in order, file after file; it holds one batch of lines.

    Its functions are local, so that workers without this package run them.
    """
    import bisect
    import hashlib
    from urllib.parse import unquote

    import pyarrow as pa

    types = (("path", pa.string()), ("sha256", pa.string()), ("length", pa.int64()))

    def closed(path, size, digests, length):
        # Every line but the last was followed by a line feed. What the lines lack in length tells the rest: one
        # byte is a last line feed, three a byte-order mark that the reader left out.
        lacking = size - length
        if lacking not in (0, 1, 3, 4):
            raise ValueError(f"{path} changed while it was read: {length} of {size} bytes")
        digest = digests[lacking > 2]
        if lacking in (1, 4):
            digest.update(b"\n")
        # Paths of the metadata column are escaped as in a URI.
        row = (unquote(path), digest.hexdigest(), size)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, types)], [n for n, _ in types])

    def hash_lines(batches):
        path, size, digests, length = None, 0, (), 0
        for batch in batches:
            columns = batch.to_pydict()
            start, rows = 0, len(columns["path"])
            while start < rows:
                name = columns["path"][start]
                end = bisect.bisect_right(columns["path"], name, start)
                block = b"\n".join(columns["line"][start:end])
                if name == path:
                    block = b"\n" + block
                else:
                    if path is not None:
                        yield closed(path, size, digests, length)
                    path, size, length = name, columns["size"][start], 0
                    digests = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                for digest in digests:
                    digest.update(block)
                length += len(block)
                start = end
        if path is not None:
            yield closed(path, size, digests, length)

    return hash_lines


def fingerprints(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 and size of each input file.

    SHA-256 runs through a file in order, so one task hashes it. Files of up to `whole_bytes` are read at once. Larger
    ones are read in splits, as raw lines, which are sorted (the sort spills) and streamed through the hash, so a file
    may exceed the 2 GB of a value. Large compressed files cannot be read so and are read at once as well.
    """
    binary = spark.read.format("binaryFile")
    files = binary.load(path)
    # The length is tested before a file is opened; a test of its name would come after.
    digests = files.where(F.col("length") <= whole_bytes)
    beyond = files.where(F.col("length") > whole_bytes).select("path", F.col("path").rlike(_UNPACKED).alias("packed")).collect()
    large, packed = ([r.path for r in beyond if r.packed == kind] for kind in (False, True))
    if packed:
        digests = digests.unionByName(binary.load(packed))
    digests = digests.select("path", F.sha2("content", 256).alias("sha256"), "length")
    if large:
        lines = spark.read.text(large, lineSep="\n").select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"),
            F.col("value").cast("binary").alias("line"),
        )
        ordered = lines.repartition(len(large), "path").sortWithinPartitions("path", "_start", "_n")
        digests = digests.unionByName(ordered.select("path", "size", "line").mapInArrow(_line_hasher(), _DIGEST))
    return digests.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("sha256").alias("file_hash"), F.col("length").alias("size_bytes"),
    )

"""Sensor text files, their headers, path parts and map files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_AXES = "timestamp bigint, x double, y double, z double, accuracy int"
_BOTH = "timestamp bigint, x double, y double, z double, x2 double, y2 double, z2 double, accuracy int"

# Record types and the columns after the type mark, the time first.
RECORDS = {
    "accelerometer": _AXES,
    "accelerometer_uncalibrated": _BOTH,
    "beacon": "timestamp bigint, uuid string, major_id string, minor_id string, tx_power int, rssi int, distance double, mac_addr string, timestamp2 bigint",
    "gyroscope": _AXES,
    "gyroscope_uncalibrated": _BOTH,
    "magnetic_field": _AXES,
    "magnetic_field_uncalibrated": _BOTH,
    "rotation_vector": _AXES,
    "waypoint": "timestamp bigint, x double, y double",
    "wifi": "timestamp bigint, ssid string, bssid string, rssi int, frequency int, last_seen_timestamp bigint",
}


def with_path_parts(df, names, col="path") -> DataFrame:
    """The last parts of a file path as columns, the file name without its ending."""
    parts = F.split(F.col(col), "/")
    out = {n: F.element_at(parts, i - len(names)) for i, n in enumerate(names)}
    last = names[-1]
    out[last] = F.regexp_replace(out[last], r"\.[^.]*$", "")
    return df.withColumns(out)


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def records(lines: DataFrame) -> DataFrame:
    """Fields per record: header lines out, lines that hold several records cut apart.

    A further record starts 14 characters, a 13-digit time and a tab, before its mark.
    """
    body = lines.filter(~F.col("value").startswith("#"))
    one = body.select("path", F.explode(F.split("value", r"(?<!^)(?=.{14}TYPE_)")).alias("_line"))
    fields = F.split(F.rtrim("_line"), "\t")
    return one.select("path", F.get(fields, F.lit(1)).alias("_type"), fields.alias("_f"))


def read_sensor_text(spark: SparkSession, path, types: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One typed table per record type, each with the file path; missing fields are NULL."""
    rows = records(_lines(spark, path))
    out = {}
    for name, spec in (types or RECORDS).items():
        cols: list[Column] = []
        for i, field in enumerate(spec.split(", ")):
            col, kind = field.split(" ")
            at = F.get("_f", F.lit(0 if i == 0 else i + 1))
            cols.append(at.try_cast(kind).alias(col))
        out[name] = rows.filter(F.col("_type") == f"TYPE_{name.upper()}").select("path", *cols)
    return out


def read_sensor_meta(spark: SparkSession, path) -> DataFrame:
    """Header entries, key:value parts of the lines that start with #, as rows."""
    head = _lines(spark, path).filter(F.col("value").startswith("#"))
    part = head.select("path", F.explode(F.split(F.rtrim("value"), "\t")).alias("_p")).filter(F.col("_p") != "#")
    return part.select("path", F.trim(F.regexp_replace(F.get(F.split("_p", ":", 2), F.lit(0)), "^#", "")).alias("key"), F.get(F.split("_p", ":", 2), F.lit(1)).alias("value"))


def read_floor_info(spark: SparkSession, path) -> DataFrame:
    """Width and height of each map file."""
    d = spark.read.schema("map_info struct<height:double,width:double>").json(path, multiLine=True)
    return d.select(F.col("_metadata.file_path").alias("path"), "map_info.height", "map_info.width")


def read_geojson(spark: SparkSession, path, lines=False) -> DataFrame:
    """One row per feature with its index and geometry; the first feature is the floor, the others its stores.

    A file is one map, or with ``lines`` each line is. Coordinates stay JSON text, as
    their depth depends on the geometry type.
    """
    shape = "type string, features array<struct<geometry:struct<type:string,coordinates:string>>>"
    d = spark.read.schema(shape).json(path, multiLine=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("type").alias("map_type"), F.posexplode("features").alias("feature", "_f"))
    return d.select("path", "map_type", "feature", F.col("_f.geometry.type").alias("kind"), F.col("_f.geometry.coordinates").alias("coordinates"))


def bbox(df, coordinates="coordinates") -> DataFrame:
    """Bounding box of polygon or multi-polygon coordinates: xmin, xmax, ymin, ymax."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    axis = lambda i: F.transform(F.regexp_extract_all(coordinates, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(i)), lambda v: v.cast("double"))
    return df.withColumns({
        "xmin": F.array_min(axis(1)), "xmax": F.array_max(axis(1)), "ymin": F.array_min(axis(2)), "ymax": F.array_max(axis(2)),
    })

"""Delimited tables with optional point or WKT geometry, converters, directories of tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that hold WKT, compared without case.
WKT_NAMES = ("geometry", "wkt")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ";") -> DataFrame:
    """A delimited file or folder with a header; types are inferred only without a schema."""
    reader = spark.read.option("sep", sep).option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_folder(spark: SparkSession, path: str, schema: str | None = None, sep: str = ";") -> DataFrame:
    """All tables of a folder, with the file's name as ``table_name``: one result for each group of it."""
    df = read_csv(spark, path, schema, sep)
    return df.withColumn("table_name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1))


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """A folder of part files with headers; geometry columns have to be WKT or plain coordinates."""
    df.write.option("sep", sep).option("header", True).mode("overwrite").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def wkt_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.lower() in WKT_NAMES), None)


def points(df: DataFrame, x: str = "X", y: str = "Y", drop: bool = False) -> DataFrame:
    """Adds ``geometry`` as struct<x, y>, NULL where a coordinate is missing or NaN."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    point = F.when(there, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    out = df.withColumn("geometry", point)
    return out.drop(x, y) if drop else out


def wkt_coordinates(wkt: str | Column) -> Column:
    """All coordinate pairs of a WKT text, as array<struct<x, y>>."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    number = r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
    pairs = F.regexp_extract_all(c, F.lit(rf"({number}\s+{number})"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def wkt_points(df: DataFrame, wkt: str, drop: bool = True) -> DataFrame:
    """Adds ``geometry`` from a WKT column: a point struct for points, else the list of coordinates as ``ring``."""
    out = df.withColumn("ring", wkt_coordinates(wkt))
    out = out.withColumn("geometry", F.when(F.upper(F.col(wkt)).startswith("POINT"), F.get("ring", F.lit(0))))
    return out.drop(wkt) if drop and wkt != "geometry" else out


def read_geo(spark: SparkSession, path: str, schema: str | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """By the path's ending a GeoJSON file (``.geojson``, ``.json``); else a table with a WKT column, or else with point
    coordinates. ``schema`` is that of the columns or, for GeoJSON, of the properties."""
    if path.lower().endswith((".geojson", ".json")):
        return read_geojson(spark, path, schema)
    df = read_csv(spark, path, schema)
    name = wkt_column(df)
    return wkt_points(df, name) if name else points(df, x, y)


def read_geojson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The features of GeoJSON files: a feature collection each, or one feature a line.

    Columns are the properties (all of them as text without a schema), ``geometry`` (a point struct, NULL for others) and
    ``ring``: the coordinates of a point, a line, or the outer ring of a polygon; of a multi-part geometry the first part.
    """
    whole = spark.read.text(path, wholetext=True).where("value LIKE '%FeatureCollection%'")
    kind = f"struct<properties:{f'struct<{schema}>' if schema else 'map<string,string>'},geometry:struct<type:string,coordinates:string>>"
    collections = whole.select(F.explode(F.from_json("value", f"struct<features:array<{kind}>>")["features"]).alias("f"))
    lines = spark.read.text(path).select(F.from_json("value", "struct<type:string," + kind[7:]).alias("f")).where("f.type = 'Feature'")
    rows = collections.unionByName(lines.select(F.struct("f.properties", "f.geometry").alias("f")))
    flat, one, two, three = (f"array<{'array<' * n}double{'>' * n}>" for n in range(4))
    raw = F.col("f.geometry.coordinates")
    parts = {"Point": F.array(F.from_json(raw, flat)), "LineString": F.from_json(raw, one), "MultiPoint": F.from_json(raw, one), "Polygon": F.get(F.from_json(raw, two), F.lit(0))}
    parts |= {"MultiLineString": F.get(F.from_json(raw, two), F.lit(0)), "MultiPolygon": F.get(F.get(F.from_json(raw, three), F.lit(0)), F.lit(0))}
    ring = F.coalesce(*[F.when(F.col("f.geometry.type") == name, c) for name, c in parts.items()])
    ring = F.transform(ring, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    rows = rows.withColumn("ring", ring).withColumn("geometry", F.when(F.col("f.geometry.type") == "Point", F.get("ring", F.lit(0))))
    if schema:
        return rows.select("f.properties.*", "geometry", "ring")
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("f.properties"))).distinct().collect())  # column names
    return rows.select(*[F.try_element_at("f.properties", F.lit(n)).alias(n) for n in names], "geometry", "ring")


def write_geojson(df: DataFrame, path: str, ring: str | None = None, kind: str = "Polygon") -> None:
    """One feature a line: points from ``geometry``, or the coordinates in ``ring`` as a geometry of that kind (``Polygon``
    or ``LineString``); the other columns are its properties."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("geometry", "ring")]
    pair = lambda p: F.array(p["x"], p["y"])
    if ring:
        path_of = F.transform(F.col(ring), pair)
        shape = F.struct(F.lit(kind).alias("type"), (F.array(path_of) if kind == "Polygon" else path_of).alias("coordinates"))
    else:
        shape = F.when(F.col("geometry").isNotNull(), F.struct(F.lit("Point").alias("type"), pair(F.col("geometry")).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*others).alias("properties"), shape.alias("geometry"))
    df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_nonspatial(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = read_csv(spark, path, schema)
    return df.drop(*[c for c in df.columns if c.lower() in WKT_NAMES])


def point_wkt(df: DataFrame) -> DataFrame:
    """A point layer as a table with ``wkt``, ``x`` and ``y``."""
    wkt = F.format_string("POINT (%s %s)", F.col("geometry.x"), F.col("geometry.y"))
    return df.select(*[c for c in df.columns if c != "geometry"], wkt.alias("wkt"), F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"))


def read_extent(spark: SparkSession, path: str) -> DataFrame:
    """The first geometry of a layer, as its ring."""
    df = read_csv(spark, path)
    return df.select(wkt_coordinates(wkt_column(df)).alias("ring")).limit(1)


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf8"))


def web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees to spherical Mercator metres; the only transformation besides identity."""
    r = 6378137.0
    return F.radians(x) * r, F.ln(F.tan(F.lit(3.141592653589793 / 4) + F.radians(y) / 2)) * r


def html_table(rows: list[dict]) -> str:
    """A small report of metric rows."""
    if not rows:
        return "<table></table>"
    cell = lambda tag, v: f"<{tag}>{'' if v is None else v}</{tag}>"
    head = "".join(cell("th", k) for k in rows[0])
    body = "".join("<tr>" + "".join(cell("td", v) for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"

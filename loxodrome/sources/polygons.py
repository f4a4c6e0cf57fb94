"""Polygon layers as rows with ``rings``: array<array<struct<x, y>>>, in degrees; no projection is applied."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.sources.tables import must_exist

# Attribute names of layers and what they become.
ATTRIBUTES = {"Unit": "unit_code", "UnitName": "unit_name", "UNIT_NAME": "unit_name", "UNIT_CODE": "unit_code"}
_RINGS = "array<array<struct<x:double,y:double>>>"


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings of each polygon record; null shapes have none."""
    out, at = [], 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        rings = []
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", data, body + 36)
            first = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2], strict=True))
            rings = [xy[a:b] for a, b in zip(first, first[1:], strict=False)]
        out.append(rings)
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """Attribute rows as text."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[pos : pos + width].decode("utf-8", "replace").strip()
            pos += width
        rows.append(row)
    return rows


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``polygon_seq, unit_code, unit_name, rings`` of a .shp with its .dbf beside it; a task reads a layer's files."""
    must_exist(spark, path)
    stem = path[: -len(".shp")]
    files = spark.read.format("binaryFile").load([path, f"{stem}.dbf"]).select(F.lit(0).alias("one"), F.lower(F.substring("path", -3, 3)).alias("ext"), "content")
    both = files.groupBy("one").agg(*[F.max(F.when(F.col("ext") == e, F.col("content"))).alias(e) for e in ("shp", "dbf")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf in zip(frame["shp"], frame["dbf"], strict=True):
                rows = []
                for i, (rings, raw) in enumerate(zip(parse_shp(shp), parse_dbf(dbf), strict=True)):
                    row = {ATTRIBUTES.get(k, k): v for k, v in raw.items()}
                    rows.append((i, row.get("unit_code"), row.get("unit_name"), [[{"x": x, "y": y} for x, y in r] for r in rings]))
                yield pd.DataFrame(rows, columns=["polygon_seq", "unit_code", "unit_name", "rings"])

    return both.select("shp", "dbf").mapInPandas(run, f"polygon_seq long, unit_code string, unit_name string, rings {_RINGS}")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygons and multipolygons of a feature collection, parsed by Spark's own JSON functions."""
    must_exist(spark, path)
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["features"]).alias("polygon_seq", "f"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = lambda rs: F.transform(rs, lambda r: F.transform(r, point))
    single = rings(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    several = F.flatten(F.transform(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"), rings))
    names = {n: [k for k, v in ATTRIBUTES.items() if v == n] + [n] for n in ("unit_code", "unit_name")}
    unit = [F.coalesce(*[F.col("f.properties")[k] for k in keys]).alias(n) for n, keys in names.items()]
    return rows.select(F.col("polygon_seq").cast("long").alias("polygon_seq"), *unit, F.when(F.col("f.geometry.type") == "MultiPolygon", several).otherwise(single).alias("rings"))


def boxes(spark: SparkSession, rows: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Rectangles (unit, x0, x1, y0, y1) as polygons."""
    d = [(i, u, u, [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]) for i, (u, x0, x1, y0, y1) in enumerate(rows)]
    return spark.createDataFrame(d, f"polygon_seq long, unit_code string, unit_name string, rings {_RINGS}")


def glb_chunks(data: bytes) -> tuple[dict, bytes]:
    """The JSON and the binary chunk of a glTF 2 container."""
    if data[:4] != b"glTF" or struct.unpack_from("<I", data, 4)[0] != 2:
        raise ValueError("not a glTF 2 binary")
    at, found = 12, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<I4s", data, at)
        found[kind] = data[at + 8 : at + 8 + size]
        at += 8 + size
    if b"JSON" not in found:
        raise ValueError("the container has no JSON chunk")
    return json.loads(found[b"JSON"]), found.get(b"BIN\0", b"")


def glb_texture(data: bytes, image: int = 0) -> bytes:
    """The bytes of an embedded image."""
    head, body = glb_chunks(data)
    images = head.get("images", [])
    if image >= len(images) or "bufferView" not in images[image]:
        raise ValueError("no embedded image")
    view = head["bufferViews"][images[image]["bufferView"]]
    start = view.get("byteOffset", 0)
    return body[start : start + view["byteLength"]]


def glb_status(spark: SparkSession, path: str, texture: str | None = None) -> dict:
    """What of a viewer's files is there, with sizes."""
    out = {}
    for key, p in (("model", path), ("texture", texture)):
        rows = spark.read.format("binaryFile").load(p).select("length").collect() if p and _there(spark, p) else []
        out |= {f"{key}_exists": bool(rows), f"{key}_bytes": rows[0]["length"] if rows else 0}
    return out


def _there(spark: SparkSession, path: str) -> bool:
    from loxodrome.sources.tables import exists

    return exists(spark, path)

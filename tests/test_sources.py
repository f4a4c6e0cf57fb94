import json
import struct

import pytest

from loxodrome.config import Grid
from loxodrome.operators.grid import base_grid
from loxodrome.sources import models, polygons, sinks, tables

CATALOG = "Name,Longitude,Latitude,Temperature_K,Source\nPele,255.0,-19.0,1700.0,Galileo\nLoki,308.8,12.6,600.0,Voyager\nPrometheus,153.5,-2.7,,Galileo\nNowhere,,1.0,1,x\nBad,abc,1.0,1,x\n"


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_hotspot_catalog(spark, tmp_path):
    path = put(tmp_path, "c.csv", CATALOG)
    rows = {r["name"]: r for r in tables.hotspot_catalog(spark, path).collect()}
    assert set(rows) == {"Pele", "Loki", "Prometheus"}
    assert rows["Pele"]["longitude"] == -105.0 and rows["Prometheus"]["longitude"] == 153.5 and rows["Prometheus"]["temperature"] is None
    assert all(r["provenance"] == path for r in rows.values())
    assert tables.hotspot_catalog(spark, path, normalize_longitude=False).filter("longitude > 180").count() == 2
    with pytest.raises(FileNotFoundError, match="not found"):
        tables.hotspot_catalog(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing required columns"):
        tables.hotspot_catalog(spark, put(tmp_path, "x.csv", "x,y,z\n1,2,3\n"))
    far = put(tmp_path, "far.csv", "Name,Longitude,Latitude\na,-200,95\nb,1,1\n")
    kept = tables.hotspot_catalog(spark, far)
    assert kept.count() == 2 and tables.out_of_range(kept).count() == 1


def test_power_catalog(spark, tmp_path):
    path = put(tmp_path, "p.csv", "name,longitude,latitude,power_gw\n,350,1,1\nb,-181,2,2\nc,10,3,0\nd,20,4,\n")
    rows = tables.power_catalog(spark, path).collect()
    assert sorted(r["longitude"] for r in rows) == [-10.0, 179.0] and "" in {r["name"] for r in rows}
    assert all(r["power_is_estimated"] and r["basis_column"] for r in rows)
    assert tables.power_catalog(spark, put(tmp_path, "q.csv", "name,longitude,latitude,power_gw\na,180,0,1\n")).first()["longitude"] == -180.0


def test_flux_sources(spark, tmp_path):
    proxy = tables.synthetic_flux(spark)
    assert proxy.count() == 64800 and tables.synthetic_flux(spark, 2.0).count() == 16200
    assert proxy.filter("flux_w_m2 < 0").count() == 0 and "SYNTHETIC" in proxy.first()["provenance"]
    with pytest.raises(ValueError, match="flux_w_m2"):
        tables.flux_csv(spark, put(tmp_path, "f.csv", "longitude,latitude\n1,2\n"))
    cells = base_grid(spark, Grid(30.0))
    out = tables.add_flux(cells, tables.synthetic_flux(spark, 30.0), grid=Grid(30.0))
    assert out.count() == cells.count() and out.filter("tidal_heating_flux is null").count() == 0
    with pytest.raises(ValueError, match="flux_w_m2"):
        tables.add_flux(cells, cells)
    assert tables.download_mapping(spark.createDataFrame([(None, "10", "2", "z"), ("a", "x", "1", "z")], "Volcanic_C string, Long_E string, Lat string, More string")).collect() == [("Unnamed", 10.0, 2.0)]


def test_registry(spark, tmp_path):
    path = put(tmp_path, "m.csv", "longitude,latitude,flux_w_m2\n0,0,1\n100,50,2\n")
    reg = dict(models.REGISTRY) | {"M3": models.FluxModel("d" * 100, "r" * 100, "not_available", "csv", path), "tif": models.FluxModel("", "", "available", "geotiff", path)}
    assert models.available(spark, reg) == ["uniform", "tif"]  # a file alone doesn't make a model available
    listing = {r["name"]: r for r in models.listing(spark, reg).collect()}
    assert listing["M3"]["file_exists"] and listing["M3"]["status"] == "not_available" and len(listing["M3"]["description"]) == 83
    aligned = models.load(spark, "M3", reg, 30.0)
    assert aligned.count() == 72 and {r[0] for r in aligned.select("flux_w_m2").distinct().collect()} == {1.0, 2.0}
    assert models.load(spark, "uniform", reg, 30.0).filter("flux_w_m2 = 1").count() == 72
    with pytest.raises(KeyError):
        models.load(spark, "none", reg)
    with pytest.raises(NotImplementedError):
        models.load(spark, "tif", reg)


def test_stored_tables_name_their_builder(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="base_grid"):
        tables.base_grid_table(spark, str(tmp_path / "g.parquet"))
    path = sinks.parquet(base_grid(spark, Grid(30.0)), str(tmp_path / "g.parquet"))
    assert tables.base_grid_table(spark, path).count() == 72


def test_polygon_sources(spark, tmp_path):
    ring, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    pts = [*ring, *hole]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, len(pts), 0, 5) + b"".join(struct.pack("<2d", *p) for p in pts)
    (tmp_path / "u.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"UnitName\0\0\0" + b"C" + bytes(4) + bytes([6]) + bytes(15)
    (tmp_path / "u.dbf").write_bytes(b"\3\0\0\0" + struct.pack("<IHH", 1, 65, 7) + bytes(20) + field + b"\x0d" + b" Alpha ")
    row = polygons.shapefile(spark, str(tmp_path / "u.shp")).first()
    assert row["unit_name"] == "Alpha" and [[tuple(p) for p in r] for r in row["rings"]] == [ring, hole]
    f = {"type": "FeatureCollection", "features": [{"properties": {"UNIT_NAME": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"unit_name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [hole]]}}]}
    rows = polygons.geojson(spark, put(tmp_path, "u.json", json.dumps(f))).orderBy("polygon_seq").collect()
    assert [(r["unit_name"], len(r["rings"])) for r in rows] == [("A", 1), ("B", 2)] and [tuple(p) for p in rows[1]["rings"][1]] == hole


def test_glb(spark, tmp_path):
    head = json.dumps({"images": [{"bufferView": 0}], "bufferViews": [{"byteOffset": 2, "byteLength": 3}]}).encode()
    head += b" " * (-len(head) % 4)
    data = b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", 8, b"BIN\0") + b"xxPNGyyy"
    assert polygons.glb_texture(data) == b"PNG"
    (tmp_path / "m.glb").write_bytes(data)
    assert polygons.glb_status(spark, str(tmp_path / "m.glb"), str(tmp_path / "t.png")) == {"model_exists": True, "model_bytes": len(data), "texture_exists": False, "texture_bytes": 0}
    with pytest.raises(ValueError):
        polygons.glb_chunks(b"nope" + bytes(20))


def test_sinks(spark, tmp_path):
    path = sinks.json_file(spark, {"a": float("nan"), "b": [1, {"c": base_grid(spark, Grid(90.0)).select("cell_id")}]}, f"{tmp_path}/r.json")
    got = json.loads(open(path).read())
    assert got["a"] is None and len(got["b"][1]["c"]) == 8
    sinks.suite({"t": base_grid(spark, Grid(90.0))}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/t.csv")).count() == 8

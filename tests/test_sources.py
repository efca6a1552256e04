"""Readers and sinks on small files."""

import random
import sqlite3
import struct
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import polygons, space
from tessera.sources import readers, sinks, wkb
from tessera.streaming import windows

GRAPH = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><key id="d3" for="edge" attr.name="oneway"/>
<graph edgedefault="directed"><node id="1"><data key="d0">1.5</data><data key="d1">2</data></node><node id="2"/>
<edge source="1" target="2" id="0"><data key="d2">10.5</data><data key="d3">True</data></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    nodes, arcs = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert [(r.node_id, r.x) for r in nodes.orderBy("node_id").collect()] == [("1", 1.5), ("2", None)]
    r = readers.typed(arcs).first()
    assert (r.u, r.v, r.key, r.length, r.oneway, r.highway) == ("1", "2", 0, 10.5, True, None)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 0.0)]
    body = struct.pack("<I4dII", 5, 0, 0, 2, 2, 1, 3) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body
    field = b"UBIGEO".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    shp += struct.pack(">II", 2, len(body) // 2) + body
    dbf = bytes([3, 0, 0, 0]) + struct.pack("<IHH", 2, 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\x0d" + b" 010101" + b"*020202"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.shp", shp)
        z.writestr("d.dbf", dbf)
    (r,) = readers.shapefile(spark, str(tmp_path / "d.zip")).collect()
    assert r.attributes["UBIGEO"] == "010101" and [(p.x, p.y) for p in r.rings[0]] == ring
    assert readers.districts(spark, str(tmp_path / "d.zip"), ["010101"]).first().code == "010101"
    with pytest.raises(ValueError, match="020202"):  # the row is marked as deleted
        readers.districts(spark, str(tmp_path / "d.zip"), ["010101", "020202"])


def test_graphml_in_blocks_equals_the_whole(spark, tmp_path):
    rng = random.Random(3)
    nodes = [(f"n{k}", rng.uniform(-77, -76), rng.uniform(-13, -12)) for k in range(40)]
    arcs = [(rng.choice(nodes)[0], rng.choice(nodes)[0], k, f"Calle <{k}> & \u00d1 \"x\"" + "y" * rng.choice([0, 3, 400])) for k in range(60)]
    body = "".join(f'  <node id="{i}"><data key="d0">{x!r}</data><data key="d1">{y!r}</data></node>\n' for i, x, y in nodes)
    body += "".join(f"  <edge source='{u}' target='{v}' id='{k}'>\n    <data key='d2'>{escape(name)}</data><data key='d3' />\n  </edge>\n" for u, v, k, name in arcs)
    body += '<edge source="n1" target="n2"/>'
    keys = "".join(f'<key id="d{k}" for="all" attr.name="{name}" attr.type="string"/>' for k, name in enumerate(("x", "y", "name", "note")))
    (tmp_path / "g.graphml").write_text(f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">\n{body}</graph></graphml>\n', encoding="utf-8")
    try:
        for block in (1 << 20, 2000, 300):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
            got_nodes, got_arcs = readers.graphml(spark, str(tmp_path / "g.graphml"))
            assert sorted((r.node_id, r.x, r.y) for r in got_nodes.collect()) == sorted(nodes)
            got = sorted((r.u, r.v, r.key, r.data.get("name")) for r in got_arcs.collect())
            assert got == sorted([*arcs, ("n1", "n2", 0, None)], key=lambda a: a[:3]) or sorted(map(repr, got)) == sorted(map(repr, [*arcs, ("n1", "n2", 0, None)]))
            if block == 2000:
                assert spark.read.option("lineSep", "<").text(str(tmp_path / "g.graphml")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


SQUARE, HOLE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)]


def test_wkb_of_both_byte_orders(spark):
    big = struct.pack(">BI", 0, 3) + struct.pack(">I", 1) + struct.pack(">I", 4) + struct.pack(">8d", 0, 0, 1, 0, 1, 1, 0, 0)
    heights = struct.pack("<BI", 1, 1001) + struct.pack("<3d", 5, 6, 7)
    extended = struct.pack("<BIi", 1, 0x20000000 | 0x80000000 | 2, 4326) + struct.pack("<I", 2) + struct.pack("<6d", 0, 0, 9, 1, 1, 9)
    got = [wkb.parsed(x) for x in (big, heights, extended)]
    assert [(k, [[r.tolist() for r in p] for p in parts]) for k, parts in got] == [("polygon", [[[[0, 0], [1, 0], [1, 1]]]]), ("point", [[[[5, 6]]]]), ("line", [[[[0, 0], [1, 1]]]])]
    rows = [("point", [[SQUARE[:1]]]), ("line", [[SQUARE]]), ("polygon", [[SQUARE, HOLE]]), ("multipolygon", [[SQUARE, HOLE], [HOLE]]), ("multipoint", [[SQUARE[:1]], [HOLE[:1]]]), ("multiline", [[SQUARE], [HOLE]]), ("polygon", []), ("point", []), (None, None)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id int, kind string, parts {wkb.SHAPE}")
    back = wkb.read(wkb.write(frame)).orderBy("id").collect()
    assert [(r.kind, r.parts and [[[(p.x, p.y) for p in ring] for ring in part] for part in r.parts]) for r in back] == [(k, p) for k, p in rows]
    area = polygons.decomposed(wkb.polygons(wkb.read(wkb.write(frame.where("id = 2"))))).select(space.pieces_area(F.col("pieces"))).first()[0]
    assert area == 15.5
    for broken in (b"", big[:20], struct.pack("<BI", 1, 17)):
        with pytest.raises(ValueError):
            wkb.parsed(broken)


def test_projected_layer_of_a_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "o.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('water', 'geom')")
    db.execute("CREATE TABLE water (fid INTEGER PRIMARY KEY, fclass TEXT, geom BLOB)")
    for k, kind in enumerate(("river", "dock", "river")):
        x = -75.0 + k
        raw = wkb.written("multipolygon", [[np.array([(x, -12.0), (x + 0.01, -12.0), (x + 0.01, -11.99), (x, -11.99)])]])
        db.execute("INSERT INTO water VALUES (?, ?, ?)", (k, kind, b"GP\0\x03" + struct.pack("<i4d", 4326, x, x + 0.01, -12, -11.99) + raw))
    db.execute("INSERT INTO water VALUES (9, 'river', NULL)")
    db.commit()
    db.close()
    read = lambda **more: readers.projected_layer(spark, str(tmp_path / "o.gpkg"), "water", ["fclass"], **more)
    (row,) = read(box=(-75.5, -13, -74.5, -11), only={"fclass": ("river", "riverbank")}).collect()
    corner = row.parts[0][0][0]
    assert (row.kind, round(corner.x), 8.6e6 < corner.y < 8.7e6) == ("multipolygon", 500000, True)
    area = abs(polygons.signed_area(np.array([(p.x, p.y) for p in row.parts[0][0]])))
    assert area == pytest.approx(0.01**2 * 110_600 * 108_900, rel=0.01)
    assert read().count() == 3
    with pytest.raises(ValueError, match="nothing"):
        read(only={"fclass": ("canal",)})


def test_geopackage_with_box(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "o.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
    db.execute("CREATE TABLE roads (fclass TEXT, geom BLOB)")
    for k in range(3):
        db.execute("INSERT INTO roads VALUES (?, ?)", (f"c{k}", b"GP\0\x03" + struct.pack("<i4d", 4326, k, k + 0.5, 0, 1) + b"wkb%d" % k))
    db.commit()
    db.close()
    got = readers.geopackage(spark, str(tmp_path / "o.gpkg"), "roads", ["fclass"], (0.9, 0.0, 1.9, 1.0)).collect()
    assert [(r.fclass, bytes(r.wkb)) for r in got] == [("c1", b"wkb1")]


def test_geopackage_by_its_index(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "o.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
    db.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, fclass TEXT, geom BLOB)")
    db.execute("CREATE VIRTUAL TABLE rtree_roads_geom USING rtree(id, minx, maxx, miny, maxy)")
    for k in range(4):
        db.execute("INSERT INTO roads VALUES (?, ?, ?)", (k + 10, f"c{k}", b"GP\0\x03" + struct.pack("<i4d", 4326, k, k + 0.5, 0, 1) + b"wkb%d" % k))
        db.execute("INSERT INTO rtree_roads_geom VALUES (?, ?, ?, 0, 1)", (k + 10, k, k + 0.5))
    db.execute("INSERT INTO roads VALUES (20, 'none', NULL)")
    db.commit()
    db.close()
    read = lambda box: sorted((r.fclass, r.wkb and bytes(r.wkb)) for r in readers.geopackage(spark, str(tmp_path / "o.gpkg"), "roads", ["fclass"], box).collect())
    assert read((0.9, 0.0, 2.2, 1.0)) == [("c1", b"wkb1"), ("c2", b"wkb2")]
    assert len(read(None)) == 5 and ("none", None) in read(None)


def test_metric_points(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# stations\nnombre,lat,lng\nA,-12.05,-77.04\nB,-12.05,-75.5\n")
    box = [(200_000.0, 8_600_000.0), (400_000.0, 8_600_000.0), (400_000.0, 8_700_000.0), (200_000.0, 8_700_000.0)]
    got = readers.stations(spark, str(tmp_path / "s.csv"), "nombre string, lat double, lng double", box).collect()
    assert [(r.nombre, r.capa) for r in got] == [("A", "estacion")]
    both = readers.named_points(spark, {"x": (-12.05, -77.04), "y": (-12.05, -75.5)})
    assert both.count() == 2 and both.where("nombre = 'x'").first().x == got[0].x


def test_csv_json_and_arms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ubigeo,n\n# note\n010101,3\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), "ubigeo string, n int", "#").first().ubigeo == "010101"
    (tmp_path / "a.json").write_text('{"results": [{"ring": "a", "rr": 1.5},\n {"ring": "b", "rr": 2}]}')
    assert readers.json_results(spark, str(tmp_path / "a.json"), "ring string, rr double").count() == 2
    df = spark.createDataFrame([("x", 1), ("y", 2)], "m string, v int")
    assert {r.m for r in readers.with_arms(df, "m", {"x": "uniform"}).collect()} == {"uniform"}
    with pytest.raises(ValueError, match="missing arms"):
        readers.with_arms(df, "m", {"x": "a", "z": "b"})


def test_cache_artifact_and_manifest(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "c")
    assert sinks.cached(spark, path, {"v": 1}, make).count() == 1
    assert sinks.cached(spark, path, {"v": 1}, make).count() == 1
    assert sinks.cached(spark, path, {"v": 2}, make).count() == 2 and len(calls) == 2
    sinks.artifact(spark.range(9).withColumnRenamed("id", "k"), str(tmp_path / "art"), "k", 1)
    m = sinks.manifest(spark, str(tmp_path / "art/*.parquet"))
    assert [r.state for r in sinks.compared(m, m).collect()] == ["same"]


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp_seconds(1704067200 + id * 600) AS ts, cast(id % 2 AS string) AS kind FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.hourly_counts(stream, "ts", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.kind): r.n for r in spark.table("hourly").collect()}
    want = {(r.start, r.kind): r.n for r in windows.hourly_counts(rows, "ts", ["kind"]).collect()}
    assert got == want and sum(got.values()) == 60


def test_streamed_hits_meet_windows_over_midnight(spark, tmp_path):
    from tessera.streaming import windows

    day = "2024-03-01 "
    rows = [("a", day + "23:30:00"), ("a", "2024-03-02 00:30:00"), ("a", "2024-03-02 02:00:00"), ("b", day + "23:30:00"), (None, day + "23:30:00")]
    events = spark.createDataFrame(rows, "stadium string, at string").selectExpr("stadium", "timestamp(at) AS at")
    events.write.parquet(f"{tmp_path}/in")
    looks = spark.createDataFrame([("a", day + "23:00:00", "2024-03-02 02:00:00", 1), ("a", day + "20:00:00", day + "23:30:00", 2)], "stadium string, f string, t string, stratum int")
    looks = looks.selectExpr("stadium", "timestamp(f) AS from_ts", "timestamp(t) AS to_ts", "stratum")
    stream = windows.stratum_hits(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "at", looks)
    query = stream.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(str(r.at) for r in spark.table("hits").collect()) == ["2024-03-01 23:30:00", "2024-03-02 00:30:00"]
    assert {r.stratum for r in spark.table("hits").collect()} == {1}

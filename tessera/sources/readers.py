"""Typed scans. Codes with leading zeros are never inferred; required columns are checked before use."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from html import unescape
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import strict_bool
from tessera.operators.space import in_ring, utm18s
from tessera.sources import wkb
from tessera.sources.shared import stored


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Projected scan: only the named columns are read."""
    df = spark.read.parquet(path)
    lost = set(columns or ()) - set(df.columns)
    if lost:
        raise ValueError(f"{path} lacks {sorted(lost)}")
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """CSV with header and declared types; lines that start with ``comment`` are skipped."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def metric_points(df: DataFrame, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """``df`` (lat, lng) with metric ``x, y``; with a metric ring, the points inside it."""
    x, y = utm18s(F.col("lat"), F.col("lng"))
    out = df.withColumn("x", x).withColumn("y", y)
    if ring is None:
        return out
    corners = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
    return out.where(in_ring(F.col("x"), F.col("y"), corners))


def stations(spark: SparkSession, path: str, schema: str, ring: list[tuple[float, float]] | None = None, layer: str = "estacion") -> DataFrame:
    """Points of a CSV file with comment lines, as metric points of a layer."""
    return metric_points(csv(spark, path, schema, "#").withColumn("capa", F.lit(layer)), ring)


def named_points(spark: SparkSession, places: dict[str, tuple[float, float]], ring: list[tuple[float, float]] | None = None, layer: str = "estadio") -> DataFrame:
    """A short literal list of places (name: latitude, longitude) as metric points of a layer."""
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in places.items()], "nombre string, lat double, lng double")
    return metric_points(rows.withColumn("capa", F.lit(layer)), ring)


def tagged(spark: SparkSession, paths: dict[str, str], schema: str, tag: str) -> DataFrame:
    """Several CSV files in long form, each with a constant column."""
    out = None
    for name, path in paths.items():
        part = csv(spark, path, schema).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_arms(df: DataFrame, column: str, arms: dict[str, str]) -> DataFrame:
    """Rows of the named arms, renamed; raises if an arm is absent."""
    found = {r[0] for r in df.where(F.col(column).isin(*arms)).select(column).distinct().collect()}
    if found != set(arms):
        raise ValueError(f"missing arms: {sorted(set(arms) - found)}")
    names = F.create_map(*[F.lit(x) for pair in arms.items() for x in pair])
    return df.where(F.col(column).isin(*arms)).withColumn(column, names[F.col(column)])


def json_results(spark: SparkSession, path: str, schema: str, field: str = "results") -> DataFrame:
    """The rows of a list inside a JSON document."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(field))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, text)`` of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))
    return whole.select("file", F.posexplode(F.split("doc", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Begins of a tag's name and attributes, and the entities of XML (fixed values of the format).
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _element(tags: list[str], names_of: str) -> tuple:
    """``(kind, u, v, key, data)`` of one node, edge or key, from its tags, each with the text behind it."""
    attributes = lambda tag: {k: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(tag.split(">", 1)[0])}
    head = attributes(tags[0])
    if names_of == "key":
        return "key", head.get("id"), head.get("attr.name"), None, []
    data = {}
    for tag in tags[1:]:
        if re.split(r"[\s>/]", tag, maxsplit=1)[0].rsplit(":", 1)[-1] == "data":
            text = tag.split(">", 1)[1] if not tag.split(">", 1)[0].endswith("/") else ""
            data[attributes(tag).get("key")] = unescape(text)
    first = head.get("id") if names_of == "node" else head.get("source")
    return names_of, first, head.get("target"), head.get("id"), list(data.items())


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete elements of each block of a file; what a block cuts off at its ends comes as text with its place."""
    kinds, out, open_, block, lead = ("node", "edge", "key"), [], [], None, None

    def text(side: str, tags: list[str]) -> None:
        out.append((side, block[0], block[1], block[2], None, [("text", "<".join(tags))]))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
        found = pa.RecordBatch.from_arrays([pa.array([None if x is None else x if k == 5 else str(x) for x in c], t) for k, (c, t) in enumerate(zip(cols, types, strict=True))], names=["kind", "file", "u", "v", "key", "data"])
        out.clear()
        return found

    def take(tag: str) -> None:
        nonlocal open_, lead
        name = tag.split(">", 1)[0].rstrip("/").split(None, 1)
        name = name[0].rsplit(":", 1)[-1] if name else ""
        closing = name.startswith("/")
        name = name.lstrip("/")
        if lead is not None:  # before the first element that begins in this block: the end of the one before
            if name in kinds and not closing:
                text("head", lead)
                lead = None
            else:
                lead.append(tag)
                return
        if open_:
            open_.append(tag)
        elif name in kinds and not closing:
            open_ = [tag]
        if open_ and name in kinds and (closing or tag.split(">", 1)[0].endswith("/")):
            kind, *rest = _element(open_, name)
            out.append((kind, block[0], *rest))
            open_ = []

    def end() -> None:
        nonlocal open_
        if block is not None:
            if lead is not None:
                text("through", lead)
            elif open_:
                text("tail", open_)
        open_ = []

    for batch in batches:
        for value, file, start, length in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start", "length")], strict=True):
            if block is None or block[:2] != (file, start):
                end()
                block, lead = (file, start, start + length), [] if start else None
            take(value)
            if len(out) >= 4096:
                yield flush()
    end()
    yield flush()


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, arcs)`` of GraphML files, which are split into blocks and read once, by as many tasks as there are blocks.

    A row of the text reader is a tag with the text behind it. A task makes elements of them; elements that a block
    cuts are put together from what its end and the next blocks' begins hold. Attributes come as a map of text, named
    by the keys of their file; ``typed`` picks and types them.
    """
    raw = spark.read.option("lineSep", "<").text(path)
    tags = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    found = stored(tags.mapInArrow(_elements, "kind string, file string, u string, v string, key string, data map<string,string>"), "graphml")
    cut = found.where("kind IN ('tail', 'head', 'through')").select("file", F.col("u").cast("long").alias("start"), "kind", F.col("data")["text"].alias("text"))
    # an element that begins in a block ends in the next block in which another one begins; of a file's blocks each has a row or two
    w = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    tail, head = (F.max(F.when(F.col("kind") == k, F.col("start"))).over(w) for k in ("tail", "head"))
    of = F.when(F.col("kind") == "tail", F.col("start")).when(F.coalesce(head, F.lit(-1)) <= tail, tail)
    grouped = cut.withColumn("of", of).where("of IS NOT NULL")
    whole = grouped.groupBy("file", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.when(F.col("kind") == "tail", 1).otherwise(0).alias("k"), "text"))), lambda x: x["text"]), "<").alias("text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tags = content.split("<")
                name = tags[0].split(">", 1)[0].split(None, 1)[0].rsplit(":", 1)[-1]
                kind, *rest = _element(tags, name)
                rows.append((kind, file, *rest))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:5]], pa.array(cols[5], pa.map_(pa.string(), pa.string()))], names=["kind", "file", "u", "v", "key", "data"])

    all_ = found.where("kind IN ('node', 'edge', 'key')").unionByName(whole.select("file", "text").mapInArrow(close, "kind string, file string, u string, v string, key string, data map<string,string>"))
    # the keys of a file are the few attributes it declares
    names = all_.where("kind = 'key'").groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("u", "v"))).alias("names"))
    rows = all_.where("kind <> 'key'").join(names, "file", "left").withColumn("data", F.when(F.col("names").isNull(), F.col("data")).otherwise(F.transform_keys("data", lambda k, _: F.coalesce(F.col("names")[k], k)))).drop("names")
    nodes = rows.where("kind = 'node'").select(F.col("u").alias("node_id"), F.col("data")["x"].cast("double").alias("x"), F.col("data")["y"].cast("double").alias("y"), F.col("data")["street_count"].cast("int").alias("street_count"))
    arcs = rows.where("kind = 'edge'").select("u", "v", F.coalesce(F.col("key").try_cast("int"), F.lit(0)).alias("key"), "data")
    return nodes, arcs


def typed(arcs: DataFrame, numbers: tuple[str, ...] = ("length", "travel_time", "speed_kph"), flags: tuple[str, ...] = ("oneway",), texts: tuple[str, ...] = ("highway", "name", "osmid")) -> DataFrame:
    """Attributes of ``graphml`` arcs as columns; flags are parsed strictly."""
    return arcs.select("u", "v", "key", *[F.col("data")[n].cast("double").alias(n) for n in numbers], *[strict_bool(F.col("data")[n]).alias(n) for n in flags], *[F.col("data")[n].alias(n) for n in texts])


def _shape_rows(raw: bytes) -> tuple[list[dict], list[list]]:
    """Attributes and rings of a zipped polygon shapefile, without deleted rows."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        name = next(n for n in z.namelist() if n.endswith(".shp"))
        shp, dbf = z.read(name), z.read(name[:-4] + ".dbf")
    count, start, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    table, gone = [], []
    for k in range(count):
        at, row = start + k * size + 1, {}
        gone.append(dbf[at - 1] == ord("*"))
        for field, width in fields:
            row[field] = dbf[at : at + width].decode("utf-8", "replace").strip()
            at += width
        table.append(row)
    rings, at = [], 100
    while at < len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        parts = []
        if struct.unpack_from("<I", shp, at + 8)[0] in (5, 15, 25):
            n, points = struct.unpack_from("<II", shp, at + 44)
            cuts = [*struct.unpack_from(f"<{n}I", shp, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * n)
            parts = [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(cuts, cuts[1:], strict=False)]
        rings.append(parts)
        at += 8 + 2 * words
    live = [k for k in range(count) if not gone[k]]
    return [table[k] for k in live], [rings[k] for k in live]


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``(attributes, rings)`` of zipped polygon shapefiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            for content in batch.column("content"):
                table, rings = _shape_rows(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([list(r.items()) for r in table], pa.map_(pa.string(), pa.string())), pa.array(rings, ring)], names=["attributes", "rings"])

    return _files(spark, path).select("content").mapInArrow(run, "attributes map<string,string>, rings array<array<struct<x:double,y:double>>>")


def districts(spark: SparkSession, path: str, codes: list[str], field: str = "UBIGEO") -> DataFrame:
    """``(code, ring)`` of the named districts: a point is in their union if it is inside an odd number of one's rings.

    Raises on a code without a polygon; the codes asked for bound what is looked up on the driver.
    """
    rows = shapefile(spark, path).select(F.col("attributes")[field].alias("code"), "rings").where(F.col("code").isin(*codes) & (F.size("rings") > 0))
    lost = set(codes) - {r[0] for r in rows.select("code").distinct().collect()}
    if lost:
        raise ValueError(f"no polygon for {sorted(lost)}")
    return rows.select("code", F.explode("rings").alias("ring"))


def geopackage(spark: SparkSession, path: str, layer: str, columns: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Columns and WKB of a layer, opened in memory; ``box`` (west, south, east, north) keeps rows whose envelope meets it.

    Where the layer has a spatial index, SQLite reads only the rows that it names. A row without a geometry has a NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        names = ", ".join(f'"{c}"' for c in columns)
        for batch in batches:
            for content in batch.column("content"):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                shape = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
                index = f"rtree_{layer}_{shape}"
                near, bound = "", ()
                if box and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (index,)).fetchone():
                    near, bound = f' WHERE rowid IN (SELECT id FROM "{index}" WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?)', (box[2], box[0], box[3], box[1])
                rows = [(*r[:-1], *_wkb(r[-1])) for r in db.execute(f'SELECT {names}{", " if names else ""}"{shape}" FROM "{layer}"{near}', bound)]
                if box:
                    rows = [r for r in rows if r[-1] is None or (r[-1][0] <= box[2] and r[-1][1] >= box[0] and r[-1][2] <= box[3] and r[-1][3] >= box[1])]
                cols = list(zip(*[r[:-1] for r in rows], strict=True)) or [[] for _ in range(len(columns) + 1)]
                yield pa.RecordBatch.from_arrays([*[pa.array([None if x is None else str(x) for x in c], pa.string()) for c in cols[:-1]], pa.array(cols[-1], pa.binary())], names=[*columns, "wkb"])

    return _files(spark, path).select("content").mapInArrow(run, ", ".join([*[f"`{c}` string" for c in columns], "wkb binary"]))


def _wkb(blob: bytes | None) -> tuple[bytes | None, tuple | None]:
    """WKB and envelope (x0, x1, y0, y1) of a GeoPackage geometry."""
    if blob is None:
        return None, None
    order = "<" if blob[3] & 1 else ">"
    kind = blob[3] >> 1 & 7
    return blob[8 + (0, 32, 48, 48, 64)[kind] :], struct.unpack_from(order + "4d", blob, 8) if kind else None


def projected_layer(spark: SparkSession, path: str, layer: str, columns: list[str], box: tuple[float, float, float, float] | None = None, only: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``columns``, ``kind`` and metric ``parts`` of a GeoPackage layer of degrees: box first, then the values to keep, then the projection.

    Raises if nothing is left, as without shapes or barriers there is no ground to share out. Rows without a geometry are
    left out.
    """
    rows = geopackage(spark, path, layer, columns, box)
    for column, values in (only or {}).items():
        rows = rows.where(F.col(column).isin(*values))
    rows = wkb.read(rows).where(F.size("parts") > 0)
    if rows.isEmpty():
        raise ValueError(f"{layer} has nothing of {only or 'any kind'} in {box or 'any box'}")

    def metric(p: Column) -> Column:
        x, y = utm18s(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return rows.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, metric))))

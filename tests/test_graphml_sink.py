"""One GraphML file from many tasks."""

import hashlib
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tessera.sources import graphml_sink, readers

TEXTS = ['Calle <1> & "Ñ"', "a\tb\nc\rd", "", None, "]]>'"]


def graph(spark, n=50):
    k = F.col("id")
    texts = F.array(*[F.lit(t) for t in TEXTS])
    nodes = spark.range(n).repartition(5).select(F.concat(F.lit("n<"), k).alias("node_id"), (k / 7).alias("x"), F.when(k % 3 > 0, -k / 9).alias("y"), (k % 5).cast("int").alias("street_count"))
    arcs = spark.range(3 * n).repartition(7).select(
        F.concat(F.lit("n<"), k % n).alias("u"), F.concat(F.lit("n<"), (k * 7 + 1) % n).alias("v"), (k % 2).cast("int").alias("key"),
        (k * 1e9).alias("length"), (k % 2 == 0).alias("oneway"), texts[(k % len(TEXTS)).cast("int")].alias("name"),
    )
    return nodes, arcs


def test_what_is_written_reads_back(spark, tmp_path):
    path = str(tmp_path / "g.v1.graphml")
    nodes, arcs = graph(spark)
    for _ in range(2):  # the second replaces the first
        graphml_sink.write(nodes, arcs, path, {"modo": "drive", "n_nodos": 50})
    rows = lambda df, *c: sorted(map(repr, map(tuple, df.select(*c).collect())))
    got_nodes, got_arcs = readers.graphml(spark, path)
    assert rows(got_nodes, "node_id", "x", "y", "street_count") == rows(nodes, "node_id", "x", "y", "street_count")
    typed = readers.typed(got_arcs, ("length",), ("oneway",), ("name",))
    assert rows(typed, "u", "v", "key", "length", "oneway", "name") == rows(arcs, "u", "v", "key", "length", "oneway", "name")
    root = ET.parse(path).getroot()
    kinds = [e.tag.rsplit("}", 1)[-1] for e in root.find("{*}graph")]
    assert kinds == ["node"] * 50 + ["edge"] * 150
    fields = json.loads((tmp_path / "g.v1.meta.json").read_text())
    assert fields == {"modo": "drive", "n_nodos": 50, "sha256": hashlib.sha256((tmp_path / "g.v1.graphml").read_bytes()).hexdigest()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g.v1.graphml", "g.v1.meta.json"]


def test_empty_tables_give_a_file_without_elements(spark, tmp_path):
    nodes, arcs = graph(spark)
    graphml_sink.write(nodes.where("false"), arcs.where("false"), str(tmp_path / "e.graphml"))
    assert len(ET.parse(tmp_path / "e.graphml").getroot().find("{*}graph")) == 0


@pytest.mark.parametrize(("u", "name", "why"), [("a", "bell \x07", "control character"), (None, "x", "u is missing")])
def test_what_xml_cannot_hold_raises_and_leaves_the_old_file(spark, tmp_path, u, name, why):
    path = tmp_path / "g.graphml"
    nodes, arcs = graph(spark, 3)
    graphml_sink.write(nodes, arcs, str(path))
    before = path.read_bytes()
    bad = spark.createDataFrame([(u, "b", 0, name)], "u string, v string, key int, name string")
    with pytest.raises(Exception, match=why):
        graphml_sink.write(nodes, bad, str(path))
    assert path.read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["g.graphml", "g.meta.json"]

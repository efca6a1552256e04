"""GraphML sink: tasks write parts, and the commit joins them into one file with a sidecar of its digest."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that the commit holds of a part at a time.
CHUNK = 1 << 20
#: First and last lines of a file (fixed values of the format).
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
TAIL = "</graph>\n</graphml>\n"


@dataclass
class Parts(WriterCommitMessage):
    """A task's number and its part of each kind of element, if it wrote any."""

    task: int
    paths: dict[int, str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.head, self.meta = options["path"], options["head"], options["meta"]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        task, out, paths = TaskContext.get(), {}, {}
        fs, base = FileSystem.from_uri(self.parts)
        fs.create_dir(base, recursive=True)
        try:
            for batch in iterator:
                for kind, element in zip(batch.column("kind").to_pylist(), batch.column("element").to_pylist(), strict=True):
                    if kind not in out:
                        # each attempt has its own name, and only parts of committed tasks are joined
                        paths[kind] = f"{base}/{task.partitionId()}-{task.taskAttemptId()}-{kind}"
                        out[kind] = fs.open_output_stream(paths[kind])
                    out[kind].write(element.encode() + b"\n")
        finally:
            for stream in out.values():
                stream.close()
        return Parts(task.partitionId(), paths)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, base = FileSystem.from_uri(self.parts)
        path = FileSystem.from_uri(self.path)[1]
        fs.create_dir(base, recursive=True)
        digest = hashlib.sha256()
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        with fs.open_output_stream(f"{base}/whole") as out:

            def put(data: bytes) -> None:
                digest.update(data)
                out.write(data)

            put(self.head.encode())
            for kind in (0, 1):
                for part in (m.paths[kind] for m in done if kind in m.paths):
                    with fs.open_input_stream(part) as source:
                        while data := source.read(CHUNK):
                            put(data)
            put(TAIL.encode())
        fields = {**json.loads(self.meta), "sha256": digest.hexdigest()}
        fs.move(f"{base}/whole", path)
        with fs.open_output_stream(sidecar_path(path)) as out:
            out.write((json.dumps(fields, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
        fs.delete_dir(base)

    def abort(self, messages: list[Parts | None]) -> None:
        fs, base = FileSystem.from_uri(self.parts)
        fs.create_dir(base, recursive=True)
        fs.delete_dir(base)


class GraphmlSink(DataSource):
    """``format("tessera_graphml")`` over ``(kind, element)``: 0 for nodes, 1 for edges."""

    @classmethod
    def name(cls) -> str:
        return "tessera_graphml"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def sidecar_path(path: str) -> str:
    """``a/b.graphml`` has its figures in ``a/b.meta.json``."""
    return re.sub(r"\.[^./]+$", "", path) + ".meta.json"


def _text(c: Column, kind: str) -> Column:
    """A value as XML text: flags as True and False, and characters that XML has no form for raise."""
    value = F.when(c, "True").when(~c, "False") if kind == "boolean" else c.cast("string")
    for plain, form in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        value = F.replace(value, F.lit(plain), F.lit(form))
    return F.when(value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.raise_error(F.lit("a text holds a control character that XML has no form for")).cast("string")).otherwise(value)


def _data(df: DataFrame, columns: list[str], first: int) -> Column:
    """The ``data`` elements of the columns that have a value."""
    kinds = dict(df.dtypes)
    each = [F.concat(F.lit(f'<data key="d{first + k}">'), _text(F.col(f"`{c}`"), kinds[c]), F.lit("</data>")) for k, c in enumerate(columns)]
    return F.concat_ws("", *each) if each else F.lit("")


def write(nodes: DataFrame, arcs: DataFrame, path: str, meta: dict | None = None) -> None:
    """One GraphML file of ``nodes`` (``node_id`` and attributes) and ``arcs`` (``u, v, key`` and attributes), and its sidecar.

    ``path`` is an address that driver and executors reach alike, and is replaced. Tasks write parts beside it; the
    commit copies them one after another, nodes first, so that neither a task nor the driver holds the graph, and puts
    the whole file in place when it is complete. A NULL attribute is left out, a NULL id raises, and a table without rows gives a file
    without elements. ``readers.graphml`` reads it back; the sidecar holds ``meta`` and the file's ``sha256``.
    """
    of_nodes, of_arcs = [c for c in nodes.columns if c != "node_id"], [c for c in arcs.columns if c not in ("u", "v", "key")]
    keys = [*[("node", c) for c in of_nodes], *[("edge", c) for c in of_arcs]]
    declared = "".join(f'<key id="d{k}" for="{of}" attr.name={quoteattr(c)} attr.type="string"/>\n' for k, (of, c) in enumerate(keys))

    def attribute(name: str, df: DataFrame, c: str) -> Column:
        value = F.coalesce(_text(F.col(c), dict(df.dtypes)[c]), F.raise_error(F.lit(f"{c} is missing")).cast("string"))
        return F.concat(F.lit(f' {name}="'), value, F.lit('"'))

    node = F.concat(F.lit("<node"), attribute("id", nodes, "node_id"), F.lit(">"), _data(nodes, of_nodes, 0), F.lit("</node>"))
    ends = [attribute(name, arcs, c) for name, c in (("source", "u"), ("target", "v"), ("id", "key"))]
    edge = F.concat(F.lit("<edge"), *ends, F.lit(">"), _data(arcs, of_arcs, len(of_nodes)), F.lit("</edge>"))
    elements = nodes.select(F.lit(0).alias("kind"), node.alias("element")).unionByName(arcs.select(F.lit(1).alias("kind"), edge.alias("element")))
    nodes.sparkSession.dataSource.register(GraphmlSink)
    head = f'{HEAD}{declared}<graph edgedefault="directed">\n'
    elements.write.format("tessera_graphml").mode("overwrite").option("head", head).option("meta", json.dumps(meta or {})).save(path)

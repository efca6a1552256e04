"""Reversible line dedup: exact reference counts, sharded cuckoo filters, exact confirmation.

``reference_counts`` keeps, for every line key, in how many documents it stands. Counts are merged
by addition, so documents can be inserted and deleted later (``changed_counts``). ``filters`` holds
the keys at or over the threshold in one cuckoo filter per shard of the key space;
``changed_filters`` inserts and deletes the keys that cross the threshold. ``drop_lines`` probes the
filters and then confirms every hit against the exact counts: a filter's false hit never costs a line.
Filters of up to ``FILTER_BYTES`` together go to every task, which probes while it reads the texts, so
only probable hits are shuffled. Beyond that the keys go to the filters: each shard's filter meets the
keys of its shard, which are dealt over ``SALTS`` parts by document, as a key may stand in a third of them.

Edge cases: a null or empty text is one empty line, and is returned as empty text; an empty key is
never dropped; a document counts once for a key however often it repeats it; rows that repeat a
``doc_id`` count as documents of their own; a null ``doc_id`` is a value like any other; very long texts
are read whole, one at a time; extra columns of any name pass through, but ``n_lines`` and ``n_dropped``
are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, unused, weighed

MIN_DOCUMENTS = 10
#: Filters together larger than this are not sent to every task; the keys are then sent to the filters.
FILTER_BYTES = 64 << 20
KEYS_PER_SHARD, SALTS = 1 << 16, 64
SLOTS, KICKS = 4, 500
#: Text that is read at a time (one text at least).
BATCH_BYTES = 4 << 20


class CuckooFilter:
    """16-bit fingerprints in buckets of four; deletion removes one copy of a fingerprint.

    When no place can be freed for a key, another table of the same size is added, and the key goes there.
    """

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        return cls([np.zeros((buckets, SLOTS), np.uint16)])

    @classmethod
    def holding(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        found = cls.sized(len(k1))
        for a, b in zip(k1.tolist(), k2.tolist(), strict=True):
            found.add(a, b)
        return found

    @staticmethod
    def _spread(fingerprint):
        return fingerprint * 0x5BD1

    def _place(self, k1: int, k2: int) -> tuple[int, int, int]:
        fingerprint, last = (k2 & 0xFFFF) or 1, len(self.tables[0]) - 1
        i = (k1 >> 20) & last
        return fingerprint, i, i ^ (self._spread(fingerprint) & last)

    def _put(self, table: np.ndarray, fingerprint: int, i: int, j: int) -> bool:
        for at in (i, j):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = fingerprint
                return True
        at, moved = i, []
        for kick in range(KICKS):
            slot = kick % SLOTS
            moved.append((at, slot, int(table[at, slot])))
            table[at, slot] = fingerprint
            fingerprint = moved[-1][2]
            at ^= self._spread(fingerprint) & (len(table) - 1)
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = fingerprint
                return True
        for at, slot, before in reversed(moved):  # nothing may be lost: all goes back
            table[at, slot] = before
        return False

    def add(self, k1: int, k2: int) -> None:
        place = self._place(k1, k2)
        if not any(self._put(table, *place) for table in reversed(self.tables)):
            self.tables.append(np.zeros_like(self.tables[0]))
            self._put(self.tables[-1], *place)

    def remove(self, k1: int, k2: int) -> bool:
        fingerprint, i, j = self._place(k1, k2)
        for table in self.tables:
            for at in (i, j):
                held = np.flatnonzero(table[at] == fingerprint)
                if len(held):
                    table[at, held[0]] = 0
                    return True
        return False

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """For each key (signed 64-bit halves): may the filter hold it?"""
        last = len(self.tables[0]) - 1
        fingerprint = np.maximum(k2 & 0xFFFF, 1)
        i = (k1 >> 20) & last
        j = i ^ (self._spread(fingerprint) & last)
        wanted = fingerprint.astype(np.uint16)[:, None]
        found = np.zeros(len(k1), bool)
        for table in self.tables:
            found |= (table[i] == wanted).any(1) | (table[j] == wanted).any(1)
        return found

    def to_bytes(self) -> bytes:
        """The number of tables, and the tables."""
        return np.uint32(len(self.tables)).tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        return cls(list(np.frombuffer(raw, np.uint16, offset=4).reshape(n, -1, SLOTS).copy()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(text: str | None) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """Lines of a text and the key of each: 128 bits of the stripped, lower-cased line; None if empty."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = []
    for line in lines:
        line = line.strip().lower()
        if line:
            h = xxhash.xxh3_128_intdigest(line)
            keys.append((_signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)))
        else:
            keys.append(None)
    return lines, keys


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of documents: line key -> number of its documents."""
    for batch in weighed(batches, "text", BATCH_BYTES):
        counts: dict[tuple[int, int], int] = {}
        for text in batch.column("text").to_pylist():
            for key in set(_keys(text)[1]):
                if key:
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.int64()), pa.array(counts.values(), pa.int64())], names=["k1", "k2", "refs"])


def reference_counts(docs: DataFrame) -> DataFrame:
    """``(k1, k2, refs)``: for each line key the exact number of documents that have it."""
    return docs.select("text").mapInArrow(_count, "k1 long, k2 long, refs long").groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))


def changed_counts(counts: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Reference counts after documents came or went; keys that nobody holds any more leave the table."""
    parts = counts.select("k1", "k2", "refs")
    if inserted is not None:
        parts = parts.unionByName(reference_counts(inserted))
    if deleted is not None:
        parts = parts.unionByName(reference_counts(deleted).withColumn("refs", -F.col("refs")))
    return parts.groupBy("k1", "k2").agg(F.sum("refs").alias("refs")).where("refs > 0")


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.col("k1"), F.lit(shards)).cast("int"))


def shard_count(keys: DataFrame) -> int:
    """So many shards that each holds about ``KEYS_PER_SHARD`` keys."""
    return max(1, -(-keys.count() // KEYS_PER_SHARD))


def filters(counts: DataFrame, min_documents: int = MIN_DOCUMENTS, shards: int = 1) -> DataFrame:
    """``(shard, shards, filter)``: one cuckoo filter of the frequent keys for each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.holding(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "shards": [shards], "filter": [made.to_bytes()]})

    return _sharded(counts.where(F.col("refs") >= min_documents), shards).select("shard", "k1", "k2").groupBy("shard").applyInPandas(build, "shard int, shards int, filter binary")


def changed_filters(old: DataFrame, before: DataFrame, after: DataFrame, min_documents: int = MIN_DOCUMENTS, shards: int = 1) -> DataFrame:
    """Filters with the keys inserted and deleted that crossed the threshold between two count tables.

    The shards stay those of ``old``; ``shards`` counts only where it has none. A full filter grows.
    """

    def high(x: DataFrame) -> DataFrame:
        return x.where(F.col("refs") >= min_documents).select("k1", "k2")

    up = high(after).join(high(before), ["k1", "k2"], "left_anti").withColumn("up", F.lit(True))
    down = high(before).join(high(after), ["k1", "k2"], "left_anti").withColumn("up", F.lit(False))
    known = old.select("shards").first()
    shards = known[0] if known else shards
    crossed = _sharded(up.unionByName(down), shards)

    def apply(key, held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        found = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(len(moves))
        for a, b, up in zip(moves["k1"].tolist(), moves["k2"].tolist(), moves["up"].tolist(), strict=True):
            if up:
                found.add(a, b)
            elif not found.remove(a, b):
                raise ValueError("the filter does not hold a key that it should: build it anew from the reference counts")
        return pd.DataFrame({"shard": [key[0]], "shards": [shards], "filter": [found.to_bytes()]})

    return old.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(apply, "shard int, shards int, filter binary")


def _probe(held):
    """Rows ``(doc_id, th, k1, k2)`` for the distinct keys of each text, of those only that a filter may hold where ``held`` has the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is not None:
            shards = held.value[0]
            tables = {k: CuckooFilter.from_bytes(v) for k, v in held.value[1].items()}
        for batch in weighed(batches, "text", BATCH_BYTES):
            ids, hashes, one, two = [], [], [], []
            for doc_id, text, th in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "th")), strict=True):
                for key in set(_keys(text)[1]):
                    if key:
                        ids.append(doc_id)
                        hashes.append(th)
                        one.append(key[0])
                        two.append(key[1])
            k1, k2 = np.array(one, np.int64), np.array(two, np.int64)
            keep = np.full(len(k1), held is None)
            if held is not None:
                shard = k1 % shards
                for s in np.unique(shard).tolist():
                    if s in tables:
                        at = np.flatnonzero(shard == s)
                        keep[at] = tables[s].holds(k1[at], k2[at])
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([hashes[i] for i in at], pa.int64()), pa.array(k1[at]), pa.array(k2[at])], names=["doc_id", "th", "k1", "k2"])

    return run


def _probe_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that their shard's filter may hold; each part of a shard begins with the filter."""
    shard, found = None, None
    names = ["doc_id", "th", "k1", "k2"]
    for batch in batches:
        now = batch.column("shard").to_numpy()
        raw = batch.column("filter")
        cuts = [0, *(np.flatnonzero(np.diff(now) | ~np.asarray(raw.is_null())[1:]) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if raw[a].is_valid:
                shard, found = now[a], CuckooFilter.from_bytes(raw[a].as_py())
                a += 1
            if a < b and now[a] == shard:
                part = batch.slice(a, b - a).select(names)
                yield part.filter(pa.array(found.holds(part.column("k1").to_numpy(), part.column("k2").to_numpy())))


def _probed_by_shard(keys: DataFrame, made: DataFrame, shards: int) -> DataFrame:
    """``keys`` that a filter may hold, with the keys sent to the filters."""
    salt = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")
    rows = _sharded(keys, shards).withColumn("salt", salt).withColumn("filter", F.lit(None).cast("binary"))
    heads = made.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return both.select("shard", "filter", "doc_id", "th", "k1", "k2").mapInArrow(_probe_sorted, "doc_id long, th long, k1 long, k2 long")


def _rewrite(names: list[str], confirmed_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighed(batches, "text", BATCH_BYTES):
            texts, total, gone = [], [], []
            for text, confirmed in zip(batch.column("text").to_pylist(), batch.column(confirmed_column).to_pylist(), strict=True):
                if confirmed:
                    drop = {(x["k1"], x["k2"]) for x in confirmed}
                    lines, keys = _keys(text)
                    left = [line for line, key in zip(lines, keys, strict=True) if key not in drop]
                    texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                    total.append(len(lines))
                    gone.append(len(lines) - len(left))
                else:
                    texts.append(text or "")
                    total.append(texts[-1].count("\n") + 1)
                    gone.append(0)
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def drop_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, counts: DataFrame | None = None) -> DataFrame:
    """``docs`` with the lines gone that stand in ``min_documents`` documents or more.

    Returns all columns of ``docs`` (``text`` rewritten) and ``n_lines`` (before), ``n_dropped``.
    ``counts`` may bring a maintained reference table; otherwise it is counted from ``docs``.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    spark = docs.sparkSession
    counts = reference_counts(docs) if counts is None else counts
    hot = stored(counts.where(F.col("refs") >= min_documents).select("k1", "k2", "refs"), "hot-lines")
    shards = shard_count(hot)
    made = stored(filters(hot, min_documents, shards), "line-filters")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = "doc_id long, th long, k1 long, k2 long"
    if (made.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= FILTER_BYTES:
        held = spark.sparkContext.broadcast((shards, {r["shard"]: r["filter"] for r in made.collect()}))
        probable = texts.mapInArrow(_probe(held), found)
    else:
        probable = _probed_by_shard(texts.mapInArrow(_probe(None), found), made, shards)
    confirmed = probable.join(hot.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))
    th, id_, th_, keys = unused(docs, "th", "id", "th_", "confirmed")
    right = confirmed.select(F.col("doc_id").alias(id_), F.col("th").alias(th_), F.col("keys").alias(keys))
    joined = docs.withColumn(th, F.xxhash64("text")).join(right, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(th_)), "left").drop(id_, th_, th)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_rewrite(names, keys), f"{types}, n_lines long, n_dropped long")

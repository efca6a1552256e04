"""Token-id output: one wavelet matrix per shard, compressed, with rank and select.

Documents are range-partitioned by ``doc_id``, so that shards in order hold ids in order. A task
encodes its documents, and packs every ``SHARD_TOKENS`` ids (whole documents) into one shard file: a
header, document ids and lengths, and for each bit of the ids, from the highest, a bit-plane in
wavelet order, in frames that are compressed one by one, with the count of ones before each frame.
From the one file, ``access`` gives the token at a place, ``rank`` and ``count`` how often a token
occurs, ``select`` and ``occurrences`` where; each opens only the frames it touches. The files are
rows of a Parquet table in the shared folder, as that is what every executor can write and read.

Edge cases: a null or empty text is its end id alone; rows that repeat a ``doc_id`` follow each other
by a hash of their text, which also splits a ``doc_id`` that very many rows share; null ids come
first; a very long text is one document of one shard, which may then hold more ids than others; an
empty table gives no shards.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sliced, stored, weighed

MAGIC = b"WVM2"
SHARD_TOKENS, END_ID = 1 << 20, 2
#: Bits of a frame of a plane, and of a block within it; frames of a plane that a reader holds open.
FRAME, BLOCK, HELD_FRAMES = 1 << 16, 1024, 64
#: Text that is encoded at a time (one text at least).
BATCH_BYTES = 4 << 20
NO_DOC = -(1 << 63)  # a null doc_id in a file


class Plane:
    """One bit-plane in frames of ``FRAME`` bits, each compressed by itself; a lookup opens only the frames it touches."""

    def __init__(self, frames: list[bytes], before: np.ndarray):
        self.frames, self.before = frames, before  # ``before``: ones before each frame, and of all
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, bits: np.ndarray, pack) -> Plane:
        raw = np.packbits(bits, bitorder="little")
        frames = [raw[k : k + FRAME // 8] for k in range(0, len(raw), FRAME // 8)]
        ones = [int(np.bitwise_count(f).sum()) for f in frames]
        return cls([pack(f.tobytes()) for f in frames], np.cumsum([0, *ones], dtype=np.int64))

    def _open(self, frame: int) -> tuple[np.ndarray, np.ndarray]:
        """A frame's bytes, and the ones before each of its blocks."""
        if frame not in self.held:
            if len(self.held) >= HELD_FRAMES:
                self.held.clear()
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[frame]), np.uint8)
            ones = np.bitwise_count(np.pad(raw, (0, -len(raw) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1)
            self.held[frame] = raw, np.r_[0, np.cumsum(ones, dtype=np.int64)]
        return self.held[frame]

    def bit(self, i: int) -> int:
        raw = self._open(i // FRAME)[0]
        return int(raw[i % FRAME >> 3] >> (i & 7)) & 1

    def ones(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        frame, i = divmod(i, FRAME)
        if not i:
            return int(self.before[frame])
        raw, ranks = self._open(frame)
        block = i // BLOCK
        part = raw[block * (BLOCK // 8) : i >> 3]
        last = int(raw[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.before[frame] + ranks[block]) + int(np.bitwise_count(part).sum()) + last.bit_count()

    def place(self, bit: int, k: int) -> int:
        """Where the ``k``-th (from 0) bit of this value stands: frame, then block, then the bits of one block."""
        before = self.before if bit else np.arange(len(self.before)) * FRAME - self.before
        frame = int(np.searchsorted(before[1:], k, side="right"))
        raw, ranks = self._open(frame)
        ranks = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        k -= int(before[frame])
        block = int(np.searchsorted(ranks[1:], k, side="right"))
        bits = np.unpackbits(raw[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return frame * FRAME + block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def all(self, n: int) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.unpackbits(np.frombuffer(b"".join(map(unpack, self.frames)), np.uint8), count=n, bitorder="little").view(bool)


class WaveletMatrix:
    """Bit-planes of unsigned 32-bit tokens in wavelet order, from the highest bit."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def of(cls, tokens: np.ndarray) -> WaveletMatrix:
        pack = zstandard.ZstdCompressor(level=1).compress
        bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        row = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = ((row >> row.dtype.type(b)).astype(np.uint8) & np.uint8(1)).view(bool)
            planes.append(Plane.of(one, pack))
            low = row[~one]
            zeros.append(len(low))
            row = np.concatenate([low, row[one]])
        return cls(len(tokens), planes, zeros)

    def access(self, i: int) -> int:
        token = 0
        for plane, z in zip(self.planes, self.zeros, strict=True):
            bit = plane.bit(i)
            ones = plane.ones(i)
            token, i = token << 1 | bit, z + ones if bit else i - ones
        return token

    def _bits(self, token: int) -> list[int]:
        return [token >> b & 1 for b in range(len(self.planes) - 1, -1, -1)]

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first ``i`` stand in the order after the last plane."""
        lo, hi = 0, i
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for plane, z, bit in zip(self.planes, self.zeros, self._bits(token), strict=True):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (z + a, z + b) if bit else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences among the first ``i`` tokens."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _up(self, token: int, at: int) -> int:
        """The place of the token that stands at ``at`` after the last plane: one select in each plane, lowest bit first."""
        for plane, z, bit in zip(self.planes[::-1], self.zeros[::-1], self._bits(token)[::-1], strict=True):
            at = plane.place(bit, at - z if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0)."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        return self._up(token, lo + k)

    def occurrences(self, token: int) -> list[int]:
        lo, hi = self._range(token, self.n)
        return [self._up(token, at) for at in range(lo, hi)]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the lowest bit up."""
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            one = self.planes[p].all(self.n)
            back = np.empty_like(row)
            back[~one] = row[: self.zeros[p]]
            back[one] = row[self.zeros[p] :] | row.dtype.type(1 << (len(self.planes) - 1 - p))
            row = back
        return row


def to_file(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One shard file: magic; numbers of documents, tokens and planes; zeros, ones and frame sizes; the compressed parts."""
    w = WaveletMatrix.of(tokens)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.array([NO_DOC if x is None else x for x in doc_ids], "<i8").tobytes()), pack(np.array(lengths, "<u4").tobytes())]
    for plane in w.planes:
        parts += plane.frames
    ones = np.concatenate([p.before for p in w.planes])
    head = struct.pack("<QQI", len(doc_ids), w.n, len(w.planes)) + b"".join(np.array(x, "<u8").tobytes() for x in (w.zeros, ones, [len(x) for x in parts]))
    return MAGIC + head + b"".join(parts)


def from_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """``(doc_ids, lengths, matrix)`` of a shard file; the matrix opens its frames as lookups need them."""
    if raw[:4] != MAGIC:
        raise ValueError("not a shard file")
    docs, n, bits = struct.unpack_from("<QQI", raw, 4)
    frames, at = -(-n // FRAME), 24

    def numbers(count: int) -> np.ndarray:
        nonlocal at
        at += 8 * count
        return np.frombuffer(raw, "<u8", count, at - 8 * count).astype(np.int64)

    zeros, ones, sizes = numbers(bits), numbers(bits * (frames + 1)), numbers(2 + bits * frames)
    ends = at + np.cumsum(sizes)
    parts = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    unpack = zstandard.ZstdDecompressor().decompress
    planes = [Plane(parts[2 + k * frames : 2 + (k + 1) * frames], ones[k * (frames + 1) : (k + 1) * (frames + 1)]) for k in range(bits)]
    return np.frombuffer(unpack(parts[0]), "<i8"), np.frombuffer(unpack(parts[1]), "<u4"), WaveletMatrix(n, planes, zeros.tolist())


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...`` (``lengths[k]`` of them) for each k, in one flat array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of whole texts, gathered from remembered ids of their chunks.

    A chunk is what stands between cuts that no pre-token crosses: before a blank, around a line end,
    and before a mark of ``TAIL`` that follows an ASCII letter or digit. A batch's bytes are cut by
    array operations and its different chunks numbered by Arrow; those that are new go to the library
    in few calls, joined by line ends: words straight to its model, and all else through its pre-tokenizer.
    """

    #: White space other than blank and line end: such texts go to the library whole.
    ODD_ASCII = "\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
    ODD_OTHER = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Marks that the pre-tokenizer parts from a letter or digit before them.
    TAIL = b".,;:!?"
    #: Characters of new chunks that go to the library in one string.
    JOINED = 1 << 16

    def __init__(self, tokenizer_file: str, cache_chunks: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(tokenizer_file)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # the byte-level alphabet: printable bytes stand for themselves, the rest are numbered from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        coded = {b: chr(256 + k) for k, b in enumerate(hidden) if b != 10}
        self.alphabet = "".join(coded.get(b, chr(b)) for b in range(256))
        self.bytes_of = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
        for token, k in self.library.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.limit = cache_chunks
        (self.line_end,) = self._whole(["\n"])[0].tolist()
        # chunk -> its place in ``at`` and ``size``, which point into ``ids``; place 0 is the line end
        self.places = {"\n": 0}
        self.ids, self.at, self.size = np.array([self.line_end], self.type), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.tail, self.plain = np.zeros(256, bool), np.zeros(256, bool)
        self.tail[list(self.TAIL)] = True
        self.plain[[b for b in range(128) if chr(b).isalnum()]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, x: str) -> bool:
        if "  " in x or "\n\n" in x or " \n" in x or "\n " in x or x[0] in " \n" or x[-1] in " \n":
            return True
        return any(c in x for c in self.ODD_ASCII) or (not x.isascii() and any(c in x for c in self.ODD_OTHER)) or any(s in x for s in self.special)

    def _joined(self, chunks: list[str]) -> list[str]:
        """The chunks joined by line ends, in strings of bounded length."""
        out, length, cut = [], 0, 0
        for k, c in enumerate(chunks):
            length += len(c) + 1
            if length > self.JOINED:
                out.append("\n".join(chunks[cut : k + 1]))
                length, cut = 0, k + 1
        return out + ["\n".join(chunks[cut:])] * (cut < len(chunks))

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for chunks that are one pre-token each: the library's model alone, parted by bytes."""
        texts = [codecs.charmap_decode(x.encode(), "strict", self.alphabet)[0] for x in self._joined(chunks)]
        ids = np.concatenate([np.array(e.ids, self.type) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        bytes_of = pc.binary_length(pa.array(chunks)).to_numpy()
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(bytes_of)) + 1
        return ids, np.diff(np.r_[0, ends])

    def _others(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any chunks: the whole library, parted by line ends."""
        ids = np.concatenate([y for x in self._whole(self._joined(chunks)) for y in (x, self.ids[:1])])
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(chunks):
            raise ValueError("the tokenizer joins chunks over a line end")
        keep = np.ones(len(ids), bool)
        keep[ends] = False
        return ids[keep], np.diff(np.r_[-1, ends]) - 1

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of new chunks."""
        column = pa.array(chunks)
        # a blank or none, then letters alone (up to U+024F, on which all versions of Unicode agree)
        letters = pc.utf8_slice_codeunits(column, 1)
        blank = pc.starts_with(column, " ")
        word = pc.and_(pc.utf8_is_alpha(pc.if_else(blank, letters, column)), pc.invert(pc.match_substring_regex(column, "[^\\x{0}-\\x{24F}]")))
        word = word.to_numpy(zero_copy_only=False).tolist()
        for some, how in (([c for c, w in zip(chunks, word, strict=True) if w], self._words), ([c for c, w in zip(chunks, word, strict=True) if not w], self._others)):
            if some:
                ids, size = how(some)
                first = len(self.at)
                self.places.update(zip(some, range(first, first + len(some)), strict=True))
                self.at = np.r_[self.at, len(self.ids) + np.cumsum(size) - size]
                self.size, self.ids = np.r_[self.size, size], np.r_[self.ids, ids]

    def _forget(self, chunks: int, ids: int) -> None:
        for c in list(itertools.islice(reversed(self.places), len(self.places) - chunks)):
            del self.places[c]
        self.at, self.size, self.ids = self.at[:chunks], self.size[:chunks], self.ids[:ids]

    def _even(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are not odd nor empty, flat, and how many each has."""
        raw = [x.encode() for x in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        line = data == 10
        cut = line | (data == 32)
        cut[1:] |= line[:-1] | (self.tail[data[1:]] & self.plain[data[:-1]])
        cut[0] = True
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        offsets = np.r_[starts, len(data)].astype(np.int32)
        column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        chunks = column.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [c for c in chunks if c not in self.places]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))[column.indices.to_numpy()]
        size = self.size[place]
        total = np.r_[0, np.cumsum(size)]
        texts_at = np.searchsorted(starts, np.r_[0, ends])
        return self.ids[spread(size, self.at[place])], np.diff(total[texts_at])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        known = len(self.places), len(self.ids)
        odd = [k for k, x in enumerate(texts) if x and self._odd(x)]
        skip = set(odd)
        even = [k for k, x in enumerate(texts) if x and k not in skip]
        out = [self.ids[:0]] * len(texts)
        for k, ids in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
            out[k] = ids
        if even:
            ids, counts = self._even([texts[k] for k in even])
            for k, part in zip(even, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[k] = part
        if len(self.places) > self.limit:  # full: what just came is not kept
            self._forget(*known)
        return out


@functools.lru_cache(1)
def encoder(tokenizer_file: str, cache_chunks: int) -> Encoder:
    """One encoder for each worker process: later tasks find what earlier ones remembered."""
    return Encoder(tokenizer_file, cache_chunks)


def _pack(tokenizer_file: str, end_id: int, shard_tokens: int, cache_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, part, number = encoder(tokenizer_file, cache_chunks), TaskContext.get().partitionId(), 0
        end = np.array([end_id], found.type)
        ids, lengths, data, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            tokens = np.concatenate(data)
            raw = to_file(ids, lengths, tokens)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([raw], pa.binary())], names=["part", "number", "tokens", "file"])

        for batch in weighed(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), found.encode(texts), strict=True):
                ids.append(doc_id)
                data += [tokens, end]
                lengths.append(len(tokens) + 1)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield shard()
                    number += 1
                    ids, lengths, data, held = [], [], [], 0
        if ids:
            yield shard()

    return run


def shards(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, cache_chunks: int = 600_000) -> DataFrame:
    """``(part, number, tokens, file)``: shard files in ascending ``doc_id`` order by ``part, number``."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie__")]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie__")).repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.mapInArrow(_pack(tokenizer_file, end_id, shard_tokens, cache_chunks), "part int, number int, tokens long, file binary")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        doc_ids, lengths, matrix = from_file(batch.column("file")[0].as_py())
        tokens = matrix.tokens().astype("<u4")
        ends = np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths
        crc = [zlib.crc32(tokens[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(doc_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if x == NO_DOC else x for x in doc_ids.tolist()], pa.int64()), pa.array([batch.column("part")[0].as_py()] * n, pa.int32()), pa.array([batch.column("number")[0].as_py()] * n, pa.int32()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "number", "at", "n_tokens", "ids_crc32"],
        )


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shard files alone."""
    sizes = files.select("part", "number", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("sum__"))
    # one row for each task of the writing job
    before = parts.select("part", F.coalesce(F.sum("sum__").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_part"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("of_shard", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(before, "part").select("part", "number", (F.col("of_part") + F.col("of_shard")).alias("offset"))
    docs = files.select("part", "number", "file").mapInArrow(_unpack, "doc_id long, part int, number int, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "number"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write the shard files into the shared folder; returns their table."""
    return stored(shards(docs, tokenizer_file, **options), "token-shards")

"""Byte-level BPE by a finite-state transducer that is determinised as texts need it; decoding by a UTF-8 state machine.

Of all ways to cut a text into tokens, the merges give the one whose neighbours all fit: a token fits after
another if merging the two together never joins across their border. That is a transducer: a state is the last
token and the place reached in the tree of all tokens, and a token is written where the tree ends one that fits.
It guesses where tokens end, so it is determinised: a state of the result holds all live guesses with the tokens
that each still owes, and what they all owe is written. A guess lives no longer than the longest token, which
bounds the lookahead. Arcs are made when a text first takes them and remembered, up to ``STATES`` states.

Decoding feeds the bytes of one id after the other to a machine that gives characters as soon as they are
complete and holds at most three bytes; bytes that are no UTF-8 give U+FFFD, one for each broken start.

Edge cases: null is the empty text; the empty text has no ids and decodes to the empty text; very long texts and
pieces take time by their length alone; repeated rows give equal rows; null ids pass through; extra columns pass
through ``encode_decode`` and ``decoded``, where their own names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import weighed

#: Text that is encoded at a time (one text at least), states and fitting pairs a worker remembers, longest piece that is remembered.
BATCH_BYTES, STATES, PAIRS, LONG = 4 << 20, 200_000, 2_000_000, 64
NEVER, START, ROOT = 1 << 60, -1, 0


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Which tokens fit after which: each token as the two parts it is merged from, down to single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte has to be a token")
        self.ranks, self.surface = ranks, {rank: token for token, rank in ranks.items()}
        self.parts = {token: self._halves(token) for token in ranks if len(token) > 1}
        self._ends: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._fits: dict[int, bool] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The last merge of a token, which all smaller ranks have to lead to."""
        symbols, whole = [bytes([b]) for b in token], self.ranks[token]
        while len(symbols) > 2:
            rank, k = min((self.ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank >= whole:
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        if len(symbols) != 2 or any(self.ranks[s] >= whole for s in symbols if len(s) > 1):
            raise ValueError(f"no merges lead to token {whole}")
        return symbols[0], symbols[1]

    def _end(self, token: int, left: bool) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while it is merged, and the rank that absorbs it."""
        found = self._ends.get((token, left))
        if found is None:
            found, symbol = [(self.surface[token], NEVER)], self.surface[token]
            while len(symbol) > 1:
                until, symbol = self.ranks[symbol], self.parts[symbol][0 if left else 1]
                found.append((symbol, until))
            self._ends[token, left] = found = found[::-1]
        return found

    def fits(self, before: int, after: int) -> bool:
        """Do both tokens come out whole when their bytes are merged together?"""
        if before == START:
            return True
        found = self._fits.get(before << 32 | after)
        if found is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            found = self._fits[before << 32 | after] = self._apart(self._end(before, False), self._end(after, True))
        return found

    def _apart(self, lefts: list[tuple[bytes, int]], rights: list[tuple[bytes, int]]) -> bool:
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = lefts[i], rights[j]
            rank = self.ranks.get(a + b, NEVER)
            # of equal ranks the leftmost merges first
            if rank < until_a and rank <= until_b:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes to token ids. States are numbered; ``arcs[state][byte]`` is the next state and the ids written."""

    def __init__(self, merges: Merges):
        self.merges = merges
        # the tree of all tokens: node and byte give a node
        self.child: dict[int, int] = {}
        self.token = [START]
        for token, rank in merges.ranks.items():
            node = ROOT
            for b in token:
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(START)
            self.token[node] = rank
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state((((), START, ROOT),))

    def _state(self, guesses: tuple) -> int:
        found = self.number.get(guesses)
        if found is None:
            found = self.number[guesses] = len(self.arcs)
            self.guesses.append(guesses)
            self.arcs.append({})
        return found

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Move every guess along the tree; the one token that ends here and fits opens a new guess."""
        live, ended = [], []
        for owed, last, node in self.guesses[state]:
            node = self.child.get(node << 8 | byte)
            if node is not None:
                live.append((owed, last, node))
                token = self.token[node]
                if token >= 0 and self.merges.fits(last, token):
                    ended.append(((*owed, token), token, ROOT))
        if len(ended) != 1:
            raise ValueError("the merges of this vocabulary are not ordered by rank")
        live += ended
        shared = 0
        for column in zip(*(g[0] for g in live), strict=False):
            if any(t != column[0] for t in column):
                break
            shared += 1
        written = live[0][0][:shared]
        return self._state(tuple((owed[shared:], last, node) for owed, last, node in live)), written

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        state, out = self.start, []
        for byte in data:
            arc = self.arcs[state].get(byte)
            if arc is None:
                if len(self.arcs) >= STATES:
                    guesses = self.guesses[state]
                    self._forget()
                    state = self._state(guesses)
                arc = self.arcs[state][byte] = self._arc(state, byte)
            state, written = arc
            if written:
                out += written
        out += self.guesses[state][-1][0]  # the text ends where the last guess begins
        return out


class Utf8:
    """Incremental UTF-8: ``feed`` gives the characters that are complete, ``close`` ends the stream."""

    #: First bytes of longer characters: how many bytes follow, and the range of the first of them (fixed values of the encoding).
    FIRST = (
        {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
        | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)}
        | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
        | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
    )

    def __init__(self) -> None:
        self.held, self.more, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.more and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.more:
                if self.low <= b <= self.high:
                    self.held += bytes([b])
                    self.more, self.low, self.high = self.more - 1, 0x80, 0xBF
                    if not self.more:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append(self.close())
            if b < 0x80:
                out.append(chr(b))
            elif b in self.FIRST:
                self.held, (self.more, self.low, self.high) = bytes([b]), self.FIRST[b]
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        broken = "�" if self.more else ""
        self.held, self.more, self.low, self.high = b"", 0, 0x80, 0xBF
        return broken


class Codec:
    """Encoder and decoder of one rank file, and the pieces that a worker remembers."""

    def __init__(self, ranks_file: str, pattern: str, cache_pieces: int):
        import regex

        merges = Merges(read_ranks(ranks_file))
        self.surface, self.transducer = merges.surface, Transducer(merges)
        self.pieces, self.limit = regex.compile(pattern).findall, cache_pieces
        self.known: dict[str, tuple[int, str, str]] = {}

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, in parts as they become complete."""
        machine = Utf8()
        for k in ids:
            part = machine.feed(self.surface[k])
            if part:
                yield part
        yield machine.close()

    def _new(self, piece: str) -> tuple[int, str, str]:
        ids = self.transducer.encode(piece.encode())
        machine = Utf8()
        found = (len(ids), ",".join(map(str, ids)), machine.feed(b"".join([self.surface[k] for k in ids])) + machine.close())
        if len(piece) <= LONG and len(self.known) < self.limit:
            self.known[piece] = found
        return found

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and the text they decode to. A piece ends with a whole character."""
        known = self.known.get
        got = [known(p) or self._new(p) for p in self.pieces(text)]
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got])


@functools.lru_cache(1)
def codec(ranks_file: str, pattern: str, cache_pieces: int) -> Codec:
    """One codec for each worker process: later tasks find the arcs and pieces of earlier ones."""
    return Codec(ranks_file, pattern, cache_pieces)


def _types(docs: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, cache_pieces: int = 400_000) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (decimals joined by commas) and ``decoded``; columns with these names are replaced."""
    docs = docs.drop("n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_file, pattern, cache_pieces)
        for batch in weighed(batches, "text", BATCH_BYTES):
            n, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                count, joined, back = of.both(text or "")
                n.append(count)
                ids.append(joined)
                texts.append(back)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[*batch.schema.names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, f"{_types(docs)}n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, ranks_file: str, pattern: str, cache_pieces: int = 400_000) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: the operator, digested in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_file, pattern, cache_pieces)
        for batch in weighed(batches, "text", BATCH_BYTES):
            n, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                count, joined, back = of.both(text or "")
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, ranks_file: str, pattern: str, cache_pieces: int = 400_000) -> DataFrame:
    """``rows`` with ``decoded``, the text of the column ``ids`` (decimals joined by commas; null: null), in any cut of the bytes."""
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_file, pattern, cache_pieces)
        for batch in weighed(batches, "ids", BATCH_BYTES):
            texts = [None if x is None else "".join(of.decode(map(int, x.split(",") if x else ()))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{_types(rows)}decoded string")

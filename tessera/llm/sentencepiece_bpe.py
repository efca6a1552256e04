"""SentencePiece BPE encoding and decoding by vectorised merge rounds in numpy.

The model file is only read for its vocabulary (pieces, scores, byte pieces). Encoding itself is
done here: the different words of an Arrow batch lie in one flat symbol array, each round finds
the best pair of every word at once, merges it, and compacts the array, until no pair remains. A
word of more than ``LONG`` characters takes its pairs from a heap instead, in the same order: where
merges of one pair may change each other, a round could do a single one.

Edge cases: null is the empty text; the empty text has no ids and decodes to the empty text; very
long texts and words without spaces are handled whole; repeated rows give equal rows; extra columns
pass through ``encode_decode``, where its own names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import weighed

#: What stands for a space inside pieces (fixed by the model format).
SPACE = "▁"
NO_RANK = np.int64(1 << 40)
#: Longest word of the rounds, and the text that is encoded at a time (one text at least).
LONG, BATCH_BYTES = 2000, 4 << 20


class Vocabulary:
    """Pieces of a BPE model as arrays: pair -> (rank, merged id), id -> bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        pieces = p.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.unknown = p.unk_id()
        self.id_of = {pieces[i]: i for i in plain}
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.splits_at_space = not any(SPACE in x.lstrip(SPACE) for x in self.id_of)
        surface = [b""] * n
        for i in plain:
            surface[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface, self.is_byte = surface, frozenset(self.byte_ids)
        self.pair = None
        # a better score is a smaller rank; equal scores have equal ranks
        scores = np.array([p.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        rows = []
        for x, i in self.id_of.items():
            rows += [(self.id_of[x[:k]], self.id_of[x[k:]], i) for k in range(1, len(x)) if x[:k] in self.id_of and x[k:] in self.id_of]
        left, right, whole = np.array(sorted(rows), dtype=np.int64).T
        self.n, self.keys, self.whole, self.rank = n, left * n + right, whole, rank[whole]
        # After a merge into m, a pair that holds m may be better than m's own. Only the leftmost
        # occurrence of such an m is merged in a round; all occurrences of any other m at once.
        best_with = np.full(n, NO_RANK)
        np.minimum.at(best_with, left, self.rank)
        np.minimum.at(best_with, right, self.rank)
        self.one_by_one = best_with <= rank
        # so too where another pair has the same rank
        tied = np.zeros(int(rank.max()) + 1, np.int64)
        np.add.at(tied, rank[plain], 1)
        self.one_by_one |= tied[rank] > 1
        size = 1 << int(np.ceil(np.log2(len(self.keys) * 8)))
        self._index(size)

    def _index(self, size: int) -> None:
        """An open-addressing table over the pair keys, filled in vectorised passes."""
        self.mask = np.int64(size - 1)
        self.slot = np.full(size, -1, np.int64)
        todo, at = np.arange(len(self.keys)), self._hash(self.keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(40)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where the vocabulary does not hold its concatenation."""
        keys = left * self.n + right
        at = self._hash(keys)
        found = self.slot[at]
        out = np.where((found >= 0) & (self.keys[found] == keys), found, -1)
        open_ = np.flatnonzero((out < 0) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            f = self.slot[at[open_]]
            hit = (f >= 0) & (self.keys[f] == keys[open_])
            out[open_[hit]] = f[hit]
            open_ = open_[~hit & (f >= 0)]
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (spaces already written as ``SPACE``), each encoded by itself."""
        if not words:
            return []
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, where = np.unique(codes, return_inverse=True)
        # a character that is no piece is spelled in bytes; it never merges with anything
        known = [self.id_of.get(chr(c), -1) for c in chars.tolist()]
        spelled = [None if i >= 0 else [self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for i, c in zip(known, chars.tolist(), strict=True)]
        symbols = np.array(known, dtype=np.int64)[where]
        origin = np.arange(len(codes))  # the first character of each symbol
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_origin, done_word = [], [], []
        pair = self._pairs_of(symbols, word)
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NO_RANK
            if not live.all():  # words without a pair are finished and leave the arrays
                keep = np.repeat(live, lengths)
                done_symbols.append(symbols[~keep])
                done_origin.append(origin[~keep])
                done_word.append(word[~keep])
                symbols, origin, word, pair, rank = (x[keep] for x in (symbols, origin, word, pair, rank))
                least, lengths = least[live], lengths[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            merged = self.whole[pair[at]]
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            single = np.zeros(int(word[-1]) + 1, bool)
            single[word[at][self.one_by_one[merged]]] = True
            take = first | ~single[word[at]]
            # leftmost of overlapping occurrences (aaa): every second one of a run
            at, merged = at[take], merged[take]
            if len(at) > 1:
                runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                place = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
                at, merged = at[place % 2 == 0], merged[place % 2 == 0]
            symbols[at] = merged
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, origin, word, pair = symbols[keep], origin[keep], word[keep], pair[keep]
            near = np.unique(np.concatenate([new, new[new > 0] - 1]))
            pair[near] = self._pairs_at(symbols, word, near)
        symbols = np.concatenate([*done_symbols, symbols])
        word = np.concatenate([*done_word, word])
        origin = np.concatenate([*done_origin, origin])
        order = np.argsort(origin, kind="stable")
        symbols, word, origin = symbols[order], word[order], origin[order]
        if (symbols < 0).any():
            ids = [[int(s)] if s >= 0 else spelled[where[o]] for s, o in zip(symbols.tolist(), origin.tolist(), strict=True)]
            word = np.repeat(word, [len(x) for x in ids])
            symbols = np.array([i for x in ids for i in x], dtype=np.int64)
        return np.split(symbols, np.searchsorted(word, np.arange(1, len(words))))

    def encode_long(self, word: str) -> list[int]:
        """Ids of one long word: pairs in the order of rank, then place, from a heap over a linked list of symbols."""
        if self.pair is None:
            self.pair = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.whole.tolist(), strict=True), strict=True))
        symbols = [self.id_of.get(c, -1) for c in word]
        n, pair, width = len(symbols), self.pair, self.n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            found = pair.get(a * width + b) if a >= 0 and b >= 0 else None
            if found:
                heapq.heappush(heap, (found[0], i, a, b, found[1]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        out = []
        for c, s in zip(word, symbols, strict=True):
            if s is not None:
                out += [s] if s >= 0 else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def _pairs_of(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._pairs_at(symbols, word, np.arange(len(symbols)))

    def _pairs_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(symbols) - 1)
        good = (at + 1 < len(symbols)) & (word[at] == word[nxt]) & (symbols[at] >= 0) & (symbols[nxt] >= 0)
        out = np.full(len(at), -1, np.int64)
        out[good] = self.pairs(symbols[at[good]], symbols[nxt[good]])
        return out

    def words_of(self, text: str) -> list[str]:
        """Cut where no piece can reach across: before a space mark that follows something else."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits_at_space:
            return [marked]
        if SPACE * 2 not in marked:
            return [SPACE + x for x in marked.split(SPACE)[1:]]
        return re.findall(f"{SPACE}+[^{SPACE}]*", marked)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: surfaces joined, the space before the first word taken off."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(1)
def vocabulary(model_file: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(model_file)


def _encoder(model_file: str, cache_words: int, want_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = vocabulary(model_file), {}
        for batch in weighed(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            words = [v.words_of(x) if x else [] for x in texts]
            fresh = list({w for x in words for w in x if w not in cache})
            now = {}
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                short = [w for w in part if len(w) <= LONG]
                pairs = [*zip(short, v.encode_words(short), strict=True), *((w, v.encode_long(w)) for w in part if len(w) > LONG)]
                for w, ids in pairs:
                    ids = ids if isinstance(ids, list) else ids.tolist()
                    now[w] = (len(ids), ",".join(map(str, ids)), b"".join(map(v.surface.__getitem__, ids)))
            if len(cache) + len(now) <= cache_words:
                cache.update(now)
                now = {}
            out = {"n_tokens": [], "ids": [], "decoded": []}
            for x in words:
                got = [cache.get(w) or now[w] for w in x] if now else [cache[w] for w in x]
                ids = ",".join([g[1] for g in got])
                raw = b"".join([g[2] for g in got])[1:]
                out["n_tokens"].append(sum([g[0] for g in got]))
                out["ids"].append(ids if want_ids else hashlib.sha256(ids.encode()).hexdigest())
                text = raw.decode("utf-8", "replace")
                out["decoded"].append(text if want_ids else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            keep = [batch.column(c) for c in batch.schema.names if c != "text" or want_ids]
            names = [c for c in batch.schema.names if c != "text" or want_ids]
            added = ("n_tokens", "ids", "decoded") if want_ids else ("n_tokens", "ids_sha256", "decoded_sha256")
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string())], names=[*names, *added])

    return run


def encode_decode(docs: DataFrame, model_file: str, cache_words: int = 400_000) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (decimals joined by commas) and ``decoded``.

    Columns of ``docs`` with these names are replaced. ``cache_words`` bounds how many different
    words a task remembers; further words are encoded whenever they come.
    """
    docs = docs.drop("n_tokens", "ids", "decoded")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_encoder(model_file, cache_words, True), f"{types}, n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, model_file: str, cache_words: int = 400_000) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: the operator, digested in the task."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_encoder(model_file, cache_words, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Spelling variants: pairs of words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary is partitioned by initial state. Before the edit, both words of a pair read the same letters, so
the composition stands in one state of the acceptor twice, and a partition is all words that leave one state of
one length: those that share a head, and read backwards those that share a tail. An edit touches the first or the
second half of a word only, so every pair meets in the partition of the other half, and in one alone: a pair
belongs to the heads if its common head is long enough. A partition of more than ``GROUP`` words is split at the
middle of what is still free, again by heads and tails, until it is small or one letter is free.

In a partition the middles of the words make two minimised acceptors, of one length and one letter more, with
shared states. Composing them with the transducer that replaces or inserts one letter leads to pairs of states
that read on alike: their common words are found once for each pair of states and numbered by their places.

Edge cases: null texts have no words; a null ``doc_id`` counts as an empty one; words of any length take time by
their length; equal texts under different ids count each time; columns beyond id and text are not read; an empty
table, or one without frequent words, gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sliced, weighed
from tessera.sources.shared import stored

#: Letters of a word, the shortest word, the fewest occurrences, every how many runs one loses a letter (the query's task).
LETTERS, SHORTEST, FEWEST, DAMAGE = "A-Za-zÀ-ÿ", 5, 3, 97
#: Words of a partition, text and different words a task holds at a time.
GROUP, BATCH_BYTES, HELD_WORDS = 4096, 4 << 20, 200_000
KEYS = ["m", "a", "b", "cap", "head", "tail"]


def counted(docs: DataFrame, shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """``(word, n)`` over all texts of ``docs`` (``doc_id``, ``text``): runs of letters with A-Z lower-cased, one in ``damage`` without a letter."""
    # in UTF-8 every letter beyond ASCII has only bytes from 0x80 up, so runs of these bytes hold whole words
    rough, exact = re.compile(rb"[a-z\x80-\xff]+").findall, re.compile(f"[{LETTERS}]+").findall

    def words(text: str) -> Counter:
        found = Counter(rough(text.encode().lower()))
        for run in [r for r in found if not r.isascii()]:
            n = found.pop(run)
            for part in exact(run.decode()):
                found[part.encode()] += n
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in weighed(batches, "text", BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in words(text or "").items():
                    if len(word) < shortest:
                        continue
                    hit = zlib.crc32(word, seed)
                    if hit % damage == 0:
                        letters = word.decode()
                        k = hit % len(letters)
                        word = (letters[:k] + letters[k + 1 :]).encode()
                    if len(word) >= shortest and (word.isascii() or len(word.decode()) >= shortest):
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimised acceptors of sorted words of equal length. Equal states are one, in all acceptors; a word's number is its place."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        #: of each state: letter -> (next state, number of words before it)
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        self.shared: dict[int, list[tuple[int, int]]] = {}

    def _state(self, arcs: tuple[tuple[str, int], ...]) -> int:
        found = self.register.get(arcs)
        if found is None:
            found = self.register[arcs] = len(self.arcs)
            before, out = 0, {}
            for letter, state in arcs:
                out[letter] = (state, before)
                before += self.size[state]
            self.arcs.append(out)
            self.size.append(before if arcs else 1)
        return found

    def accept(self, words: list[str]) -> int:
        """The initial state of ``words``."""
        path: list[list[tuple[str, int]]] = [[]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = self._state(tuple(path.pop()))
                path[-1].append((last[len(path) - 1], state))

        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            path += [[] for _ in range(len(word) - same)]
            last = word
        close(0)
        return self._state(tuple(path[0]))

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Numbers, in ``p`` and in ``q``, of the words that both states accept."""
        memo, stack = self.shared, [(p, q)]
        while stack:
            x, y = stack[-1]
            if x == y:
                memo[x << 32 | y] = [(i, i) for i in range(self.size[x])]
            else:
                a, b = self.arcs[x], self.arcs[y]
                both = [c for c in a if c in b]
                missing = [(a[c][0], b[c][0]) for c in both if a[c][0] << 32 | b[c][0] not in memo]
                if missing:
                    stack += missing
                    continue
                memo[x << 32 | y] = [(a[c][1] + i, b[c][1] + j) for c in both for i, j in memo[a[c][0] << 32 | b[c][0]]]
            stack.pop()
        return memo[p << 32 | q]

    def _common(self, p: int, q: int) -> list[tuple[int, int]]:
        found = self.shared.get(p << 32 | q)
        return self.common(p, q) if found is None else found

    def replaced(self, start: int, depth: int) -> Iterator[tuple[int, int]]:
        """Pairs of the words from ``start`` that differ by one replaced letter, within the first ``depth`` letters."""
        stack = [(start, 0, 0)]
        while stack:
            state, at, before = stack.pop()
            arcs = list(self.arcs[state].values())
            for (p, i0), (q, j0) in itertools.combinations(arcs, 2):
                for i, j in self._common(p, q):
                    yield before + i0 + i, before + j0 + j
            if at + 1 < depth:
                stack += [(p, at + 1, before + i0) for p, i0 in arcs if self.size[p] > 1]

    def inserted(self, short: int, long: int, depth: int) -> Iterator[tuple[int, int]]:
        """Words from ``short`` and those from ``long`` that have one letter more, within the first ``depth`` letters.

        A letter put into a run of itself is put at the run's end, so each pair comes once.
        """
        stack = [(short, long, 0, 0, 0)]
        while stack:
            p, q, at, i0, j0 = stack.pop()
            a, b = self.arcs[p], self.arcs[q]
            for letter, (after, j1) in b.items():
                low = high = 0
                if letter in a:
                    low = a[letter][1]
                    high = low + self.size[a[letter][0]]
                for i, j in self._common(p, after):
                    if not low <= i < high:
                        yield i0 + i, j0 + j1 + j
            if at + 1 < depth:
                stack += [(s, b[c][0], at + 1, i0 + k, j0 + b[c][1]) for c, (s, k) in a.items() if c in b]


def _pairs_of(short: list[str], long: list[str], a: int, b: int, cap: int) -> Iterator[tuple[str, str]]:
    """Near pairs of a partition whose words share ``a`` letters at the head and ``b`` at the tail, and differ before place ``cap``."""
    machine = Acceptor()
    first = machine.accept([w[a : len(w) - b] for w in short])
    for i, j in machine.replaced(first, cap - a):
        yield short[i], short[j]
    if long:
        second = machine.accept([w[a : len(w) - b] for w in long])
        for i, j in machine.inserted(first, second, cap - a):
            yield short[i], long[j]


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a task's partitions, which come sorted by ``KEYS`` and word."""
    out: list[tuple[str, int, str, int]] = []

    def rows() -> Iterator[tuple]:
        for batch in sliced(batches, 8192):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def flush() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])
        out.clear()
        return found

    for (m, a, b, cap, _, _), group in itertools.groupby(rows(), lambda r: r[:6]):
        n = {r[6]: r[7] for r in group}
        short, long = [w for w in n if len(w) == m], [w for w in n if len(w) != m]
        if not short or len(n) < 2:
            continue
        for w, v in _pairs_of(short, long, a, b, cap):
            out.append((w, n[w], v, n[v]))
            if len(out) >= 20_000:
                yield flush()
    yield flush()


def _split(rows: DataFrame) -> DataFrame:
    """Each word in the two halves of its partition; ``cap`` is the place before which the edit of a pair has to come."""
    m, a, b, cap = (F.col(c) for c in KEYS[:4])
    middle = a + F.floor((m - a - b) / 2).cast("int")

    def part(a: Column, b: Column, cap: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), cap.alias("cap"))

    halves = F.filter(F.array(part(middle, b, cap), part(a, m - middle, F.least(cap, middle))), lambda p: p["a"] < p["cap"])
    cut = rows.select("word", "n", "m", F.explode(halves).alias("p")).select("word", "n", "m", "p.a", "p.b", "p.cap")
    head, tail = F.expr("left(word, a)"), F.expr("right(word, b)")
    return cut.select(*KEYS[:4], F.when(F.col("a") > 0, head).otherwise("").alias("head"), F.when(F.col("b") > 0, tail).otherwise("").alias("tail"), "word", "n")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n, other, other_n)`` of all pairs of ``words`` (``word``, ``n``; distinct) that one inserted, deleted or replaced letter parts, each once."""
    length = F.char_length("word")
    family = F.explode(F.array(length, length - 1)).alias("m")  # as the shorter word of a pair, and as the longer one
    rows = _split(words.select("word", "n", family).where("m > 0").select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("m") + 1).alias("cap")))
    ready = None
    while True:
        sizes = stored(rows.groupBy(*KEYS).agg(F.count("*").alias("size"), F.count_if(F.char_length("word") == F.col("m")).alias("short")).where("size > 1 and short > 0"), "partitions")
        large = (F.col("size") > group) & (F.col("m") - F.col("a") - F.col("b") > 1)
        few = rows.join(sizes.where(~large).select(*KEYS), KEYS)
        ready = few if ready is None else ready.unionByName(few)
        if sizes.where(large).isEmpty():
            break
        rows = stored(_split(rows.join(sizes.where(large).select(*KEYS), KEYS)), "split-words")
    dealt = ready.select(*KEYS, "word", "n").repartition(*KEYS).sortWithinPartitions(*KEYS, "word")
    return dealt.mapInArrow(_enumerated, "word string, n long, other string, other_n long")


def variants(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (``word``, ``n``; distinct).

    The form is the near word of largest count (ties: first in code-point order) if it is at least twice as
    frequent. Counts double along forms, so roots are found by pointer jumping in as many rounds as the
    logarithm of that depth.
    """
    pairs = near_pairs(words, group)
    both = pairs.select(F.inline(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.neg"))
    frequent = F.col("form_n") >= 2 * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n")), "forms")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next__"))
        if links.join(further, "root", "left_semi").isEmpty():
            break
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("next__", "root").alias("root")), "roots")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, damage: int = DAMAGE) -> DataFrame:
    """``variants`` of the words of ``docs`` that have ``shortest`` letters and ``fewest`` occurrences."""
    return variants(stored(counted(docs, shortest, damage).where(F.col("n") >= fewest), "vocabulary"))


def variants_sql(shortest: int = SHORTEST, fewest: int = FEWEST, damage: int = DAMAGE) -> str:
    """The same over ``documents`` as DuckDB SQL; crc32 byte by byte, near words by deleted letters."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents)
), counts AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {shortest} GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
    lambda h, x: xor(h >> 8, {table}[1 + (xor(h, x) & 255)]::BIGINT))) AS h FROM counts
), damaged AS (SELECT CASE WHEN h % {damage} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {fewest}),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(k := -other_n, w := other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL),
roots AS (SELECT walk.word, walk.reached AS root FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

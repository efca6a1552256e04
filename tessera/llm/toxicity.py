"""Toxicity: bags of subword vectors, averaged, into a linear softmax; trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with word ends) and itself, each hashed to a row
of one embedding table; its vector is their mean, so that an unseen misspelling shares most of it. A
text's vector is the average of its words', and goes into a two-class softmax. The average is
weighted: each word weighs ``exp(HEAT * its own logit)``, for in an even average a long clean text
hides a toxic sentence. The same weights hold in training, where ``heat`` rises from nearly even to
``HEAT``, so embeddings and softmax are set together by the gradient of one loss. Training runs on the
driver over a bounded sample of labelled rows (``POSITIVES``, ``NEGATIVES``, ``SAMPLE_CHARS``,
``TOTAL_CHARS``), one row for each ``doc_id``. Scoring reads every word of every text. It needs only
the product of table and softmax weights, an array of fixed size, in each task.

Edge cases: null, empty and blank texts get the score of the bias alone; without labels of both
classes there is nothing to learn and all scores are 0; rows that repeat a ``doc_id`` are scored
each by itself, and one of them at most is learnt from; a ``doc_id`` with several labels counts as toxic
if one says so; a null ``doc_id`` is never a training row; a column ``score`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import mixed, sliced

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
#: How strongly a word's own logit raises its weight in the average of its text.
HEAT = 4.5
#: The bounded training sample: rows of either class, in the order of a hash of doc_id, the longest text taken, and all texts together.
POSITIVES, NEGATIVES, SAMPLE_CHARS, TOTAL_CHARS = 1500, 4000, 20_000, 24_000_000
#: Words that are weighed at a time in training.
PART_WORDS = 1 << 18
EPOCHS, RATE, SEED = 60, 0.3, 7
THRESHOLD = 0.7
ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words' subwords, flat, and where each word's begin."""
    cores = [f"<{ENDS.sub('', w) or w}>" for w in words]
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in cores])
    ends = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(cores)), lengths)
    at = np.arange(len(codes))
    rows, owner = [], []
    prime = np.uint64(0x100000001B3)
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * prime + codes[k : len(codes) - n + 1 + k]
        inside = at[: len(h)] + n <= ends[: len(h)]
        rows.append(h[inside])
        owner.append(word[: len(h)][inside])
    starts = np.cumsum(lengths) - lengths
    power = mixed(codes + (at - np.repeat(starts, lengths)).astype(np.uint64) * prime)
    rows.append(np.add.reduceat(power, starts))
    owner.append(np.arange(len(cores)))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    rows = (mixed(rows[order]) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return rows, np.searchsorted(owner[order], np.arange(len(cores)))


@dataclass
class Model:
    """``weights``: the softmax's toxic-minus-clean logit of each embedding row; ``bias``: the same without words."""

    weights: np.ndarray | None
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """Logit of each word without the bias: the mean over its subwords."""
        if not words:
            return np.empty(0)
        rows, starts = grams(words)
        return np.add.reduceat(self.weights[rows], starts) / np.diff(np.r_[starts, len(rows)])


def _tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def averaged(words: np.ndarray, heat: float = HEAT) -> float:
    """Logit of a text: the weighted average of its words' logits, which is the softmax's logit of the averaged vectors."""
    weight = np.exp(heat * (words - words.max()))
    return float(weight @ words / weight.sum())


def _slopes(flat: np.ndarray, size: np.ndarray, y: np.ndarray, s: np.ndarray, bias: float, heat: float) -> tuple[np.ndarray, float]:
    """Of the texts whose words are ``flat``: the loss's slope by each word's logit (weights held), and by the bias, as sums."""
    begin = np.cumsum(size) - size
    text = np.repeat(np.arange(len(size), dtype=np.int32), size)
    z = s[flat]
    p = np.exp(heat * (z - np.maximum.reduceat(z, begin)[text]))
    p /= np.add.reduceat(p, begin)[text]
    error = 1 / (1 + np.exp(-np.add.reduceat(p * z, begin) - bias)) - y
    return np.bincount(flat, p * error[text], len(s)), error.sum()


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit embeddings and softmax together by full-batch Adagrad."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _tokens(x)], np.int32) for x in texts]
    y = y[[len(d) > 0 for d in docs]]
    docs = [d for d in docs if len(d)]
    flat, size = np.concatenate(docs), np.array([len(d) for d in docs])
    words = list(vocabulary)
    del docs, vocabulary
    n_words, parts = len(words), [grams(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    del words
    counts = [np.diff(np.r_[at, len(r)]).astype(np.int32) for r, at in parts]
    cuts = np.cumsum([len(c) for c in counts])[:-1]
    ends = np.cumsum(size)
    edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PART_WORDS, ends[-1], PART_WORDS)), len(size)])
    spans = [(slice(i, j), slice(ends[i] - size[i], ends[j - 1])) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    rng = np.random.default_rng(seed)
    table, v = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 1, DIM)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    g_table, g_v, g_bias = np.full((BUCKETS, DIM), 1e-8), np.full(DIM, 1e-8), 1e-8
    for epoch in range(epochs):
        u = table @ v
        s = np.concatenate([np.add.reduceat(u[r], at) / n for (r, at), n in zip(parts, counts, strict=True)])
        heat = 0.5 + (HEAT - 0.5) * epoch / epochs
        ds, errors = np.zeros(n_words), 0.0
        for texts_of, words_of in spans:
            d, e = _slopes(flat[words_of], size[texts_of], y[texts_of], s, bias, heat)
            ds += d / len(y)
            errors += e / len(y)
        ds = np.split(ds, cuts)
        c = sum(np.bincount(r, np.repeat(d / n, n), BUCKETS) for (r, _), d, n in zip(parts, ds, counts, strict=True))
        d_table, d_v = c[:, None] * v, table.T @ c
        g_table += d_table**2
        g_v += d_v**2
        g_bias += errors**2
        table -= rate * d_table / np.sqrt(g_table)
        v -= rate * d_v / np.sqrt(g_v)
        bias -= rate * errors / np.sqrt(g_bias)
    return Model(table @ v, float(bias))


def held_out() -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, chars: int = SAMPLE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """At most ``positives + negatives`` labelled texts outside the held-out third, each ``doc_id`` once, of ``total`` characters at most."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    pick = known.where("toxic = 1").orderBy(order, "doc_id").limit(positives).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(negatives))
    # at most positives + negatives rows of two numbers are broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").where(F.length("text") <= chars)
    one = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    # the window without partitions runs over at most positives + negatives rows
    held = F.sum(F.length("text")).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("held__", held).where(F.col("held__") <= total).drop("held__")


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    rows = sample(docs, labels, **bounds).toPandas().sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["toxic"].tolist())


def _scores(weights, bias: float, cache_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Model(None if weights is None else weights.value, bias), {}
        for batch in sliced(batches):
            if model.weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                docs = [_tokens(x) for x in batch.column("text").to_pylist()]
                fresh = list({w for d in docs for w in d if w not in cache})
                now = dict(zip(fresh, model.words(fresh).tolist(), strict=True))
                if len(cache) + len(now) <= cache_words:
                    cache.update(now)
                    now = {}
                scores = np.full(len(docs), bias)
                for k, d in enumerate(docs):
                    if d:
                        scores[k] += averaged(np.array([cache[w] if w in cache else now[w] for w in d]) if now else np.fromiter(map(cache.__getitem__, d), float, len(d)))
                scores = 1 / (1 + np.exp(-scores))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def scored(docs: DataFrame, model: Model, cache_words: int = 400_000) -> DataFrame:
    """``docs`` with ``score`` in [0, 1], higher for likelier toxic; a column of that name is replaced."""
    docs = docs.drop("score")
    weights = None if model.weights is None else docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float64))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scores(weights, model.bias, cache_words), f"{types}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with their own columns."""
    return scored(docs, model).where(F.col("score") < threshold).select(*docs.columns)

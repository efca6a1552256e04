"""Spelling variants, byte-level BPE and centroid clustering against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bytes_bpe, centroid_clustering, queries, spelling_variants

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("group", [4096, 25, 1])
def test_near_pairs_come_once_whatever_the_partitions(spark, group):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499})
    want = sorted(tuple(sorted((a, b))) for k, a in enumerate(words) for b in words[k + 1 :] if abs(len(a) - len(b)) < 2 and near(a, b))
    got = spelling_variants.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), group).collect()
    assert sorted(tuple(sorted((r.word, r.other))) for r in got) == want


def test_a_hot_partition_is_split_and_moves_few_rows(spark):
    # words that all share a head of eight letters, a third of them alike at the tail too
    words = [f"prefixed{a}{b}{c}" + ("tailpart" if a < "j" else "") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij" for c in "klmnopqrst"]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = spelling_variants.near_pairs(frame, 64).collect()
    # each of the three letters can be replaced by any other of its range
    assert len(got) == len(set(map(tuple, got))) == 100 * (9 * 8 + 17 * 16) // 2 + 2 * 2600 * 9 // 2


def brute_variants(texts, shortest=5, fewest=3):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}
    out, form = {}, {}
    for w in n:
        by = sorted((-n[v], v) for v in n if near(w, v))
        form[w] = by[0][1] if by and -by[0][0] >= 2 * n[w] else None
        out[w] = [form[w], n[w], len(by), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def test_variants_against_brute_force(spark):
    rng = random.Random(5)
    base = ["straße", "Étude", "garden", "window", "harbour", "ÀÉÎÕÜ"]
    words = [w[:k] + rng.choice("aeé") + w[k + rng.randint(0, 1) :] for w in base for k in range(len(w)) for _ in range(3)] + base
    texts = [(k - 50, " ".join(rng.choices(words, k=60)) + "ÿ€garden\nGARDEN2harbour") for k in range(120)]
    # chains: each form twice as frequent as the word before it
    texts += [(900 + k, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96)) for k in range(2)]
    texts += [(None, "garden garden"), (7, None), (8, ""), (9, "\x00 0 "), (9, "Ж" * 50), (10, "long" * 20_000), (11, "long" * 20_000), (12, "long" * 20_000)]
    frame = spark.createDataFrame(texts, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = spelling_variants.grouped(frame).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(texts)
    assert len(got) == len({r.word for r in got})


def test_variants_of_nothing(spark):
    assert spelling_variants.grouped(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling_variants.grouped(spark.createDataFrame([(1, "only once here")], DOCS)).collect() == []


def test_acceptors_are_minimal():
    machine = spelling_variants.Acceptor()
    start = machine.accept([a + b + c for a in "ab" for b in "cd" for c in "ef"])
    assert len(machine.arcs) == 4 and machine.size[start] == 8  # one state for each letter still to come


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytes_bpe.read_ranks(queries.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def transducer():
    return bytes_bpe.Transducer(bytes_bpe.Merges(bytes_bpe.read_ranks(queries.RANKS)))


def test_transducer_equals_the_library_on_any_bytes(transducer, library, monkeypatch):
    rng, tokens = random.Random(1), list(bytes_bpe.read_ranks(queries.RANKS))
    for states in (bytes_bpe.STATES, 50):  # the second forgets its states again and again
        monkeypatch.setattr(bytes_bpe, "STATES", states)
        for k in range(3000):
            data = [b"".join(rng.choices(tokens, k=rng.randint(1, 6))), bytes(rng.choices(b"aeinst \n=", k=rng.randint(1, 40))), rng.choice([b"a", b" ", b"ab", b"=-"]) * rng.randint(1, 90), rng.randbytes(rng.randint(1, 12))][k % 4]
            assert transducer.encode(data) == library._core_bpe.encode_single_piece(data)


def test_lookahead_is_bounded(transducer):
    longest = max(map(len, transducer.merges.ranks))
    data, state, read, written = b"unbelievably " * 50 + b"x" * 500, transducer.start, 0, 0
    for byte in data:
        state, ids = transducer._arc(state, byte)
        read, written = read + 1, written + sum(len(transducer.merges.surface[k]) for k in ids)
        assert read - written <= 2 * longest


def test_vocabularies_without_an_order_of_merges_raise():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        bytes_bpe.Merges(ranks | {b"abc": 300})
    with pytest.raises(ValueError):
        bytes_bpe.Merges({k: v for k, v in ranks.items() if v != 7})


def test_utf8_comes_in_any_parts():
    rng = random.Random(3)
    for _ in range(3000):
        raw = rng.randbytes(8) if rng.random() < 0.5 else "".join(rng.choice("aé€😀ࠀ퟿") for _ in range(5)).encode()[rng.randrange(3) : rng.randrange(4, 15)]
        machine, cuts = bytes_bpe.Utf8(), sorted(rng.choices(range(len(raw) + 1), k=3))
        parts = [machine.feed(raw[i:j]) for i, j in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        assert "".join(parts) + machine.close() == raw.decode("utf-8", "replace")


def test_byte_bpe_edge_rows(spark, library):
    texts = [None, "", " ", "\n\n  \t x", "it's 1234 l'été 日本語 😀😀", "a" * 50_000, " " * 3000, "naïve " * 4000, " \u0085 x\r\n", "<|endoftext|>"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "x"), (1, "again")], DOCS).withColumn("ids", F.lit(1)).withColumn("IDs 2", F.lit(2))
    got = bytes_bpe.encode_decode(rows, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids, r.decoded, r["IDs 2"]) == (len(ids), ",".join(map(str, ids)), r.text or "", 2)
    back = bytes_bpe.decoded(bytes_bpe.encode_decode(rows, queries.RANKS, public_tokenizers.PATTERN).drop("decoded"), queries.RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bytes_bpe.encode_digests(rows.where("false"), queries.RANKS, public_tokenizers.PATTERN).collect() == []
    # ids whose bytes are cut amid a character
    cut = spark.createDataFrame([("195",), (None,), ("",)], "ids string")
    assert [r.decoded for r in bytes_bpe.decoded(cut, queries.RANKS, public_tokenizers.PATTERN).collect()][1:] == [None, ""]


def brute_clusters(vectors, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        at = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]
                if mine:
                    centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    inertia = Counter()
    for d, n in at:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, at, strict=True))


def vectors_of(count, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 64))
    return [(int(k), (centre[k % 5] * (k % 3) + rng.normal(size=64) * 0.3).tolist()) for k in range(count)]


@pytest.mark.parametrize("count", [0, 1, 5, 300])
def test_clusters_against_brute_force(spark, count):
    rows = vectors_of(count)
    if count == 300:
        one = rows[3][1]
        rows += [(1000 + k, one) for k in range(150)] + rows[:20] + [(None, rows[7][1]), (-4, [0.0] * 64), (-5, [-1e-9] * 64)]
        rows += [(2000, None), (2001, []), (2002, one[:63]), (2003, [*one, 1.0]), (2004, [float("nan"), *one[1:]]), (2005, [float("inf"), *one[1:]]), (2006, [None, *one[1:]])]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).repartition(4)
    got = centroid_clustering.clustered(frame).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert Counter(map(tuple, got)) == (brute_clusters(rows) if rows else Counter())


def test_equal_vectors_and_empty_clusters(spark):
    frame = spark.createDataFrame([(k, [0.5] * 64) for k in range(40)], "vec_id long, vec array<double>")
    got = centroid_clustering.clustered(frame).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and len(got) == 40


def test_pivots_spare_distances_and_lose_none():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 64)) * 900
    vectors = np.floor(centre[rng.integers(8, size=2000)] + rng.normal(size=(2000, 64)) * 90).astype(np.int64)
    centroids = np.r_[np.floor(centre).astype(np.int64), vectors[:2], vectors[:1]]
    pivots = centroid_clustering.chosen_pivots(vectors[:256], 12)
    found, best, measured = centroid_clustering.nearest(vectors, centroid_clustering.to_pivots(vectors, pivots), centroids, centroid_clustering.to_pivots(centroids, pivots))
    exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.5 * exact.size


def test_components_beyond_the_whole_numbers_raise(spark):
    with pytest.raises(Exception, match="does not fit"):
        centroid_clustering.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, vec array<double>")).collect()

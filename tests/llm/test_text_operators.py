"""Toxicity, line dedup, near-dedup, fingerprints and SentencePiece against brute force and on edge cases."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import fingerprints, line_dedup, minhash_dedup, sentencepiece_bpe, toxicity
from tessera.llm.common import stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t", "a", "a b c d", "x" * 50_000, "w " * 20_000, "é中\x1c  b", "a", "line\nline\n\nline"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_sentencepiece_equals_the_library(spark, library):
    random.seed(5)
    texts = [*ODD, "▁a ▁", "<s> </s> <unk>", "aaaaaaa", " " * 70, "the" * 99, "１２3 12345"]
    texts += ["".join(random.choice("ab ▁\nthe in1é中😀") for _ in range(random.randint(0, 60))) for _ in range(400)]
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(frame(spark, texts).withColumn("ids", F.lit("clash")), PIECES, cache_words=50).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k].ids == ",".join(map(str, ids)) and got[k].n_tokens == len(ids), t
        assert got[k].decoded == library.decode(ids) and got[k].lang == "en"
        assert sentencepiece_bpe.Vocabulary(PIECES).decode(ids) == got[k].decoded if k < 3 else True


def test_long_words_equal_the_library_and_take_no_long(library):
    rng = random.Random(3)
    v = sentencepiece_bpe.Vocabulary(PIECES)
    words = ["new" * 3000, "a" * 5000, "".join(rng.choices("ABCDEFabcdef0123456789+/", k=6000)), "".join(rng.choices("thein1é中😀", k=4000)), "ab"]
    for w in words:
        assert v.encode_long(sentencepiece_bpe.SPACE + w) == library.encode(w), w[:20]
    began = time.process_time()
    v.encode_long("new" * 10_667)
    assert time.process_time() - began < 2


def test_sentencepiece_digests_and_empty_table(spark, library):
    r = sentencepiece_bpe.encode_digests(frame(spark, ["Hello  world"]), PIECES).first()
    ids = library.encode("Hello  world")
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_bpe.encode_digests(frame(spark, []), PIECES).count() == 0


def key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(texts, least):
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if count.get(key(x), 0) < least]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return out


@pytest.mark.parametrize("limit", [line_dedup.FILTER_BYTES, 0])
def test_line_dedup_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", limit)
    random.seed(2)
    pool = ["Common line", "common LINE ", "\tother", "É", "é", "x", "", "  "] + [f"own {k}" for k in range(60)]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randint(1, 9))) for _ in range(120)] + ODD
    got = {r.doc_id: r for r in line_dedup.drop_lines(frame(spark, texts), 10).collect()}
    for k, want in enumerate(brute_lines(texts, 10)):
        assert (got[k].text, got[k].n_lines, got[k].n_dropped) == want
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0
    clash = frame(spark, texts)
    for c in ("id__", "th", "th_", "id", "confirmed", "n_lines"):
        clash = clash.withColumn(c, F.lit(c))
    found = line_dedup.drop_lines(clash, 10)
    assert found.columns == [*clash.drop("n_lines").columns, "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.n_dropped) for r in found.collect()} == {(r.doc_id, r.text, r.n_dropped) for r in got.values()}


def test_line_dedup_of_repeated_and_null_ids(spark):
    docs = frame(spark, ["x\ny"] * 6 + ["x\nz"] * 6, [None, None, 1, 1, 1, 2] + [1] * 6)
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.drop_lines(docs, 10).collect())
    assert got == sorted([("None", "y")] * 2 + [("1", "y")] * 3 + [("2", "y")] + [("1", "z")] * 6)


def test_line_counts_are_reversible(spark):
    a, b = frame(spark, ["x\ny", "x\nz"] * 5), frame(spark, ["x\nq", None] * 3)
    counts = line_dedup.reference_counts(a)
    grown = line_dedup.changed_counts(counts, inserted=b)
    back = line_dedup.changed_counts(grown, deleted=b)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect()))
    filters = line_dedup.filters(counts, 11)
    assert filters.count() == 0
    up = line_dedup.changed_filters(filters, counts, grown, 11).first()
    hot = grown.where("refs >= 11").first()
    held = line_dedup.CuckooFilter.from_bytes(up["filter"])
    assert held.holds(np.array([hot.k1]), np.array([hot.k2])).all()
    down = line_dedup.changed_filters(line_dedup.filters(grown, 11), grown, back, 11).first()
    assert not line_dedup.CuckooFilter.from_bytes(down["filter"]).tables[0].any()
    # the shards stay those of the old filters, whatever is asked for
    again = line_dedup.changed_filters(line_dedup.filters(grown, 1, 3), grown, back, 1, shards=8).collect()
    assert {r.shards for r in again} == {3}


def test_a_full_filter_grows_and_loses_nothing():
    rng = np.random.default_rng(4)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 3000))
    f = line_dedup.CuckooFilter.sized(100)
    for a, b in zip(k1.tolist(), k2.tolist(), strict=True):
        f.add(a, b)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert len(f.tables) > 1 and f.holds(k1, k2).all()
    assert all(f.remove(a, b) for a, b in zip(k1.tolist(), k2.tolist(), strict=True)) and not any(t.any() for t in f.tables)


def test_cuckoo_filter_holds_all_and_forgets():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    f = line_dedup.CuckooFilter.holding(k1, k2)
    assert f.holds(k1, k2).all() and f.holds(*rng.integers(-(1 << 62), 1 << 62, (2, 20000))).mean() < 0.002
    for a, b in zip(k1[:4000].tolist(), k2[:4000].tolist(), strict=True):
        assert f.remove(a, b)
    assert f.holds(k1[4000:], k2[4000:]).all()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts, percent=75):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def near_copies(count, seed=3):
    """A family of edited copies, some linked only through others, some not at all, and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for k in range(count):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
        texts.append(" ".join([*passage, *[rng.choice(words) for _ in range(rng.randint(5, 50))]]))
        if k % 9 == 0:
            texts += [texts[-2]] * 2 + [texts[-2].upper() + " \n"]
    return texts


@pytest.mark.parametrize(("block", "leaders"), [(512, minhash_dedup.LEADERS), (16, ()), (16, (1,)), (512, ())])
def test_near_dedup_against_brute_force(spark, block, leaders):
    texts = near_copies(60) + ODD + ["one two", "one two", "p q r s t u v w x y " * 40, "p q r s t u v w x y " * 41]
    want, sizes = brute_components(texts)
    got = {r.doc_id: r for r in minhash_dedup.components(frame(spark, texts), block=block, leaders=leaders).collect()}
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert all(got[k].kept == (want[k] == k) for k in got)


def test_near_dedup_edge_rows(spark):
    assert minhash_dedup.components(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b c d e f", "a b c d e f", "z", "z y", None], [7, None, 3, 3, None])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash_dedup.components(docs).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("7", "7", True), ("None", "None", True), ("None", "None", True)]
    assert minhash_dedup.deduplicated(frame(spark, ["a b c d e f"] * 3)).columns == frame(spark, []).columns


@pytest.mark.parametrize("leaders", [(1, 4), ()])
def test_near_dedup_at_another_threshold(spark, leaders):
    texts = near_copies(25, 9)
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(frame(spark, texts), threshold=0.25, leaders=leaders).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts, 25)[0]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    other = "other words stand in this one so it links with nothing at all"
    # id 5 stands on a copy and on a text of its own; 1 stands twice on the same text
    rows = [(1, text), (1, text), (5, text + " u"), (5, other), (6, text), (7, None), (7, None), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("gone__", "th", "id", "node", "first", "th_", "kept"):
        docs = docs.withColumn(c, F.lit(c))
    got = minhash_dedup.deduplicated(docs)
    assert got.columns == docs.columns and {r.th for r in got.collect()} == {"th"}
    kept = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert kept == sorted([("1", text), ("5", other), ("7", "None"), ("7", "None"), ("None", text), ("None", text)])


def test_meetings_of_sketches():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 90)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 62, rng.integers(1, 30)).astype(np.uint64)])
        pad = lambda x: np.r_[x[:64], np.full(max(0, 64 - len(x)), np.iinfo(np.uint64).max)][None]
        got = minhash_dedup.meeting(pad(a), np.array([min(64, len(a))]), pad(b), np.array([min(64, len(b))]), 64, 0.75)[0]
        both, union = np.intersect1d(a, b), np.union1d(a, b)
        if max(len(a), len(b)) < 64:
            assert got == 2 * (100 * len(both) >= 75 * len(union))
        else:
            assert got == (len(np.intersect1d(both, union[:64])) >= minhash_dedup.sketch_overlap())


def test_shared_counts_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(20)]
    got = minhash_dedup.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_near_dedup_needs_one_python_worker_a_task(spark, monkeypatch):
    """Two Python nodes in a task take two workers, whose memory adds up, and judge each meeting twice."""
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(minhash_dedup, "stored", seen)
    minhash_dedup.components(frame(spark, near_copies(20))).collect()
    nodes = {name: len(re.findall(r"\b(?:ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas)\b", plan)) for name, plan in plans.items()}
    assert nodes["met"] == 1 and max(nodes.values()) == 1, nodes


def test_fingerprints_against_brute_force(spark):
    texts = near_copies(20) + ODD
    n = len(texts)
    got = {r.doc_id: r for r in fingerprints.fingerprinted(frame(spark, texts).withColumn("next_text", F.lit("clash"))).withColumn("near", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()}
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % n] or ""
        h = len(t) // 2
        assert got[k].edited == t[: len(t) - h] + nxt[:h] and got[k].n_chars == len(t)
        assert list(got[k].sketch) == sorted(set(got[k].sketch)) and (len(got[k].sketch) > 0) == bool(t.split(" ") != [""] and t.strip(" \n\t") != "")
    same = {}
    for k, t in enumerate(texts):
        assert same.setdefault(t or "", got[k].sketch) == got[k].sketch
    long = [k for k in range(n) if len(shingles(texts[k])) > 100 and "w " not in texts[k]]
    kept = sum(len(got[k].sketch) for k in long) / sum(len(shingles(texts[k])) for k in long)
    assert kept == pytest.approx(1 / fingerprints.SCALE, rel=0.35)


def test_fingerprints_follow_ids_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 7)
    ids = random.Random(1).sample(range(-(10**12), 10**12), 90)
    rows = fingerprints.with_next(frame(spark, [f"t{i}" for i in ids], ids).select("doc_id", "text"), ["text"]).collect()
    order = sorted(ids)
    assert {r.doc_id: r.next_text for r in rows} == {i: f"t{order[(k + 1) % 90]}" for k, i in enumerate(order)}
    assert fingerprints.fingerprinted(frame(spark, [])).count() == 0


def test_merged_sketch_is_that_of_the_union(spark):
    df = spark.createDataFrame([([fingerprints.LIMIT - 5, fingerprints.LIMIT - 3], [fingerprints.LIMIT + 9]), ([fingerprints.LIMIT + 2], [fingerprints.LIMIT + 9]), ([], [])], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(fingerprints.merged(F.col("a"), F.col("b"))).collect()]
    assert got == [[fingerprints.LIMIT - 5, fingerprints.LIMIT - 3], [fingerprints.LIMIT + 2], []]


def labelled(n, seed=4):
    rng = random.Random(seed)
    syllables = ["ba", "no", "ri", "ta", "le", "mu", "ko", "si"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for k in range(n):
        t = [word() for _ in range(rng.randint(20, 150))]
        if k % 4 == 0:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(["grobnik", "zwelfer"]) + rng.choice(["", "s", "!!", "ed"])
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_toxicity_learns_and_generalises_to_misspellings():
    texts, labels = labelled(600)
    model = toxicity.train(texts[:400], labels[:400])
    score = lambda t: model.bias + toxicity.averaged(model.words(toxicity._tokens(t)))
    got = [score(t) > 0 for t in texts[400:]]
    assert np.mean([g == bool(y) for g, y in zip(got, labels[400:], strict=True)]) > 0.97
    a, b = model.words(["groobnik", "banori"])
    assert a > b + 1


def test_toxicity_edge_rows_and_bounds(spark):
    texts, labels = labelled(80)
    docs = frame(spark, texts + ODD)
    known = spark.createDataFrame([(k, 1, y) for k, y in enumerate(labels)] + [(None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, known, 5, 7).count() <= 12
    model = toxicity.fit(docs, known)
    got = toxicity.scored(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean(docs, model).columns == docs.columns
    nothing = toxicity.fit(docs, known.where("toxic = 2"))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}
    assert toxicity.scored(frame(spark, []), model).count() == 0
    # one row for each id, and no more characters than asked for
    repeated = frame(spark, [f"text {k}" for k in range(300)], [0] * 300)
    assert toxicity.sample(repeated, known).count() == 1
    held = toxicity.sample(docs, known, total=4000).collect()
    assert 0 < sum(len(r.text) for r in held) <= 4000 < sum(map(len, texts))
    # a toxic word counts wherever it stands in a long clean text
    clean = " ".join(t for t, y in zip(texts, labels, strict=True) if not y)
    low, high = (r.score for r in toxicity.scored(frame(spark, [clean * 5, clean * 5 + " grobnik"]), model).orderBy("doc_id").collect())
    assert high > low + 0.2


def test_toxicity_samples_4000_clean_rows_and_trains_alike_in_parts(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert toxicity.sample(docs, docs.select("doc_id", F.lit(0).alias("toxic"))).count() == 4000
    random.seed(5)
    texts = [" ".join(random.choices("abc bcd cde def efg fgh".split(), k=random.choice([0, 1, 2, 40]))) for _ in range(60)]
    whole = toxicity.train(texts, [k % 3 == 0 for k in range(60)], epochs=5)
    monkeypatch.setattr(toxicity, "PART_WORDS", 50)
    parts = toxicity.train(texts, [k % 3 == 0 for k in range(60)], epochs=5)
    assert abs(whole.weights - parts.weights).max() < 1e-9 and abs(whole.bias - parts.bias) < 1e-9


def test_toxicity_slopes_by_differences():
    rng = np.random.default_rng(2)
    size = np.array([3, 1, 6, 4])
    flat, y, s = rng.integers(0, 7, size.sum()), np.array([1.0, 0.0, 0.0, 1.0]), rng.normal(size=7)
    bias, heat = -0.3, 2.5
    got, by_bias = toxicity._slopes(flat, size, y, s, bias, heat)
    texts = np.split(flat, np.cumsum(size)[:-1])
    held = [np.exp(heat * s[t]) / np.exp(heat * s[t]).sum() for t in texts]  # the weights stay while a logit moves

    def loss(logits, b):
        z = [p @ logits[t] + b for p, t in zip(held, texts, strict=True)]
        return sum(np.log1p(np.exp(x)) - label * x for x, label in zip(z, y, strict=True))

    step = 1e-6
    want = [(loss(s + step * (np.arange(7) == k), bias) - loss(s - step * (np.arange(7) == k), bias)) / (2 * step) for k in range(7)]
    assert got == pytest.approx(want, abs=1e-6)
    assert by_bias == pytest.approx((loss(s, bias + step) - loss(s, bias - step)) / (2 * step), abs=1e-6)


def test_toxicity_scores_by_plain_python(spark):
    texts, labels = labelled(60)
    texts += [None, "", " \n", "grobnik", "unseen wörd " * 300, texts[0]]
    model = toxicity.train(texts[:60], labels)

    def score(text):
        logits = []
        for word in (text or "").lower().split():
            rows, _ = toxicity.grams([word])
            logits.append(sum(model.weights[r] for r in rows) / len(rows))
        if not logits:
            return 1 / (1 + math.exp(-model.bias))
        weights = [math.exp(toxicity.HEAT * x) for x in logits]
        return 1 / (1 + math.exp(-model.bias - sum(w * x for w, x in zip(weights, logits, strict=True)) / sum(weights)))

    got = {r.doc_id: r.score for r in toxicity.scored(frame(spark, texts), model).collect()}
    assert all(got[k] == pytest.approx(score(t), abs=1e-9) for k, t in enumerate(texts))

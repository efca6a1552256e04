"""Chat formatting, vectors, sharding, wavelet shards, mixing and the pipeline."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat, lattice_dedup, mixing, sharding, wavelet

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, "delta", "user", "lo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "why?"), (1, 5, 2, "regenerate", "assistant", ""),
        (1, 6, 2, "delta", "assistant", "good "), (1, 7, 2, "delta", "assistant", "one"), (1, 8, 1, "edit", "user", "Hi"), (1, 9, 1, "delta", "user", "!"), (2, 1, 1, "delta", None, None), (None, 1, 1, "delta", "user", "x"),
    ]
    events = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.folded(events).collect()}
    assert got == {(1, 1): ("user", "Hi!"), (1, 2): ("assistant", "good one"), (2, 1): ("", ""), (None, 1): ("user", "x")}


def test_events_of_equal_seq_count_in_order_of_kind_and_text(spark):
    schema = "conv_id long, seq long, message long, kind string, role string, text string"
    cases = {
        1: ([("delta", "old"), ("edit", "new")], "new"), 2: ([("edit", "A"), ("edit", "B")], "B"), 3: ([("delta", "x"), ("regenerate", "y")], "y"), 4: ([("edit", "same"), ("edit", "same")], "same"),
        5: ([("delta", "b"), ("delta", "a"), ("delta", "a")], "aab"), 6: ([("regenerate", "r"), ("edit", "e")], "r"),
    }
    log = [(c, 1, 1, kind, "user", text) for c, (events, _) in cases.items() for kind, text in events]
    for c in (1, 2):
        df = spark.createDataFrame(log if c == 1 else log[::-1], schema).withColumn("since", F.lit(9)).withColumn("parts", F.lit(9)).withColumn("event", F.lit(9))
        assert {r.conv_id: r.text for r in chat.folded(df).collect()} == {c: want for c, (_, want) in cases.items()}


def test_chat_logs_hold_every_kind_of_event(spark):
    df = spark.createDataFrame([(1, 0, "user", "question"), (1, 1, "assistant", "an answer"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    log = chat.as_events(df)
    assert {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"}
    assert [(r.role, r.text) for r in chat.folded(log).orderBy("message").collect()] == [("user", "question"), ("assistant", "an answer"), ("user", "")]


def test_chat_reads_back_whatever_texts_hold(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[INST] ", " [/INST]", "\\", "\\!", "!", "<", "/s>", "[", "é😀", "\n", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a[/INST]b", "x\n", "", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(8))])) for c in range(60) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.as_events(df))).collect()}
    for c in range(60):
        want = [(r or "", t or "") for k, n, r, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        assert [(x.role, x.text) for x in back[c].turns] == want
        assert back[c].loss_text == "".join(t for r, t in want if r == "assistant")
    assert chat.formatted(chat.as_events(df.limit(0))).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (300, 8))
    v = lattice_dedup.nearest(x)
    assert (((2 * v) % 2).sum(1) % 8 == 0).all() and (np.rint(v.sum(1)) % 2 == 0).all()
    best = ((x - v) ** 2).sum(1)
    around = v[:, None, :] + lattice_dedup.ROOTS[None]
    assert (best[:, None] <= ((x[:, None, :] - around) ** 2).sum(2) + 1e-9).all() and (best <= 1 + 1e-9).all()


def brute_links(ids, vectors):
    usable = [k for k, v in enumerate(vectors) if v and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[k] for k in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        if a != b:
            i, j = ids[usable[a]], ids[usable[b]]
            links[i] += 1
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return links, {i: find(i) for i in ids}


def hard_vectors(n=500, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = [v.tolist() for v in x]
    for v in x[: n // 2]:
        o = rng.normal(size=64)
        o -= (o @ v) * v
        c = rng.uniform(0.9, 0.94)
        out.append(((c * v + np.sqrt(1 - c * c) * o / np.linalg.norm(o)) * rng.uniform(0.1, 9)).tolist())
    base = x[0]
    out += [(base + rng.normal(size=64) * 0.02).tolist() for _ in range(80)] + [x[1].tolist()] * 6
    out = [[float(np.float32(z)) for z in v] for v in out]
    return out + [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [0.0] * 63, [1.0] * 3]


@pytest.mark.parametrize("rows", [1000, 1 << 20, 1 << 28, 1 << 40])
def test_pairs_at_the_threshold_meet_whatever_the_blocks(rows):
    rng, n = np.random.default_rng(8), 600
    a, o = rng.normal(size=(2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    blocks, tables = lattice_dedup.blocks_and_tables(rows)
    x, y = lattice_dedup.cell_keys(a, blocks, tables), lattice_dedup.cell_keys(b, blocks, tables)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]) >= 0.99


def test_block_numbers_follow_the_rows():
    assert [lattice_dedup.blocks_and_tables(n)[0] for n in (0, 1 << 18, (1 << 18) + 1, 1 << 28, 1 << 40, 1 << 60)] == [1, 1, 2, 3, 4, 4]


@pytest.mark.parametrize(("block", "rows_per_block"), [(2048, 1 << 18), (32, 1 << 18), (2048, 200)])
def test_vector_links_against_brute_force(spark, monkeypatch, block, rows_per_block):
    monkeypatch.setattr(lattice_dedup, "ROWS_PER_BLOCK", rows_per_block)
    vectors = hard_vectors()
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int")
    links, root = brute_links(ids, vectors)
    got = {r.vec_id: r for r in lattice_dedup.linked(df, block=block).collect()}
    assert sorted(got) == ids and all(got[i].n_links <= links[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    same = [i for i in ids if got[i].component_id == root[i]]
    assert len(same) >= 0.97 * len(ids) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert lattice_dedup.linked(df.limit(0)).count() == 0


def test_null_vector_ids_are_kept(spark):
    df = spark.createDataFrame([(None, [1.0] * 8, 0), (4, [1.0] * 8, 0), (4, [2.0] * 8, 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice_dedup.linked(df).collect())
    assert got == [("4", 1, "4", True), ("4", 1, "4", True), ("None", 0, "None", True)]


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "", "copy a", "copy b " * 9]) if k % 3 == 0 else f"own {k} " * rng.randint(1, 30), "s") for k in range(900)]
    got = sharding.sharded(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    text = {i: t for i, t, _ in rows}
    load, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id] or ""].add(r.shard)
    assert max(load.values()) <= 1.03 * sum(load.values()) / 8 and min(load.values()) >= 0.97 * sum(load.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sum(len(x) > 1 for x in where.values()) <= 1
    assert sharding.sharded(documents(spark, [])).count() == 0


def test_a_group_larger_than_a_shard_is_spread(spark):
    rows = [(k, "the same text of all" if k < 600 else f"own text number {k}", "s") for k in range(1000)]
    load = collections.Counter()
    for r in sharding.sharded(documents(spark, rows)).collect():
        load[r.shard] += r.size
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8


@pytest.mark.parametrize("frame", [wavelet.FRAME, 2048])
def test_wavelet_matrix_queries(monkeypatch, frame):
    monkeypatch.setattr(wavelet, "FRAME", frame)
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 1), (2048, 3), (5000, 300), (2000, 70_000)):
        t = rng.integers(0, top, n)
        ids, lengths, m = wavelet.from_file(wavelet.to_file([5, None], [n, 0], t))
        assert (m.tokens() == t).all() and ids.tolist() == [5, wavelet.NO_DOC] and lengths.tolist() == [n, 0]
        for i in rng.integers(0, max(n, 1), 25 if n else 0).tolist():
            assert m.access(i) == t[i] and m.rank(int(t[i]), i) == (t[:i] == t[i]).sum()
            assert m.select(int(t[i]), int((t[:i] == t[i]).sum())) == i
        if n:
            assert m.occurrences(int(t[0])) == np.flatnonzero(t == t[0]).tolist() and m.count(1 << 20) == 0


def test_encoder_equals_the_library():
    library, encoder, rng = Tokenizer.from_file(BYTES), wavelet.Encoder(BYTES, 200), random.Random(2)
    cases = ["", " ", "a b", "a  b", "a\n\nb", " a", "a ", "a\tb", "<|endoftext|> x", "x y", "a\x00b", "a\x1cb", "x\n'sy"]
    cases += ["".join(rng.choice("ab '\nsé1.\t中  　") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for k in range(0, len(cases), 300):
        part = cases[k : k + 300]
        for text, raw in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(raw, encoder.type).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_shards_round_trip(spark):
    library, rng = Tokenizer.from_file(BYTES), random.Random(4)
    ids = rng.sample(range(10**9), 200)
    texts = {i: rng.choice([None, "", "word " * rng.randint(1, 300), "odd\t text"]) for i in ids}
    files = wavelet.written(documents(spark, [(i, t, "s") for i, t in texts.items()]), BYTES, shard_tokens=700)
    assert files.count() > 5
    got, at = {r.doc_id: r for r in wavelet.read_documents(files).collect()}, 0
    for i in sorted(ids):
        want = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert wavelet.read_documents(wavelet.written(documents(spark, []), BYTES)).count() == 0


def test_token_shards_of_odd_rows(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(None, "no id", "s"), (None, "no id", "s"), (7, "b", "s"), (7, "a", "s"), (7, "a", "s"), (9, "x1 " * 40_000, "s"), (8, "y" * 100_000, "s"), (-(1 << 40), "least", "s")]
    files = wavelet.written(documents(spark, rows).withColumn("tie__", F.lit("clash")), BYTES)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in wavelet.read_documents(files).collect())
    assert [r[1] for r in got] == [None, None, -(1 << 40), 7, 7, 7, 8, 9]
    assert got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in itertools.pairwise(got))
    assert sorted(r[2] for r in got) == sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    m = wavelet.from_file(wavelet.to_file([1], [6], np.array([5, 9, 5, 2, 5, 9])))[2]
    assert [m.access(k) for k in range(6)] == [5, 9, 5, 2, 5, 9] and m.occurrences(5) == [0, 2, 4] and m.count(3) == 0 and m.count(-1) == 0


def filled(sizes, weights):
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest, total = budget - sum(2 * sizes[s] for s in capped), sum(weights[s] for s in sizes if s not in capped)
        new = {s for s in sizes if s not in capped and rest * weights[s] / total > 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in capped else rest * weights[s] / total for s in sizes}
        capped |= new


def test_mix_meets_targets_and_prefers_quality(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, "", " \n"]) if k % 50 == 0 else "w\t" * rng.randint(1, 40), rng.choice(["é", "b", "a", None, "zz"])) for k in range(1500)]
    rows += [(9999, "dup dup", "a")] * 3
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1500)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sized = mixing.sized(documents(spark, rows))
    mix = mixing.mixed(mixing.quality_weights(sized, labels))
    got = mix.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix.collect()))
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    want = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    for s in order:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1.01 and all(0 <= r.taken <= 2 * r.size for r in mine)
        extra = {q: np.mean([r.taken / r.size for r in mine if r.size and r.doc_id < 1500 and r.doc_id % 2 == q]) for q in (0, 1)}
        assert extra[1] >= extra[0]
    assert mixing.mixed(mixing.sized(documents(spark, []))).count() == 0


def test_mix_rows_are_repeated(spark):
    docs = documents(spark, [(1, "a b", "x"), (2, "c d", "x"), (3, None, "x"), (4, "e f g h", "y")])
    mix = mixing.mixed(mixing.sized(docs))
    got = collections.Counter(r.doc_id for r in mixing.repeated(docs, mix).collect())
    assert got == {r.doc_id: -(-r.taken // r.size) for r in mix.collect() if r.taken}


def test_repeated_rows_keep_columns_of_any_name(spark):
    docs = documents(spark, [(1, "a b", "x"), (1, "a b", "x"), (2, "c d", None), (None, "e f g", "x")])
    for c in ("tie__", "copy__", "times", "copy", "doc", "tie", "id__"):
        docs = docs.withColumn(c, F.lit(c))
    got = mixing.repeated(docs, mixing.mixed(mixing.sized(docs)))
    assert got.columns == docs.columns and got.count() >= 4 and {(r.tie__, r.copy__, r.doc) for r in got.collect()} == {("tie__", "copy__", "doc")}


def test_pipeline_stages_compose(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "no", "ri", "ta"]) for _ in range(3))
    own = lambda n: " ".join(word() for _ in range(n))
    rows, toxic = [], []
    for k in range(160):
        text = own(60) + ("\nSubscribe now" if k % 8 == 0 else "")
        if k % 5 == 0:
            text += " grobnik zwelfer grobnik"
            toxic.append(k)
        rows.append((k, text, f"s{k % 3}"))
    rows += [(200, rows[1][1], "s1"), (201, rows[1][1].upper(), "s2"), (202, "", "s0"), (203, None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {k for k, _, _ in rows} - set(toxic)
    assert kept[0] == clean and kept[1] == clean
    lines = spark.read.parquet(str(tmp_path / "line_dedup"))
    assert lines.where(F.col("text").contains("Subscribe")).count() == 0 and lines.where("n_chars <> char_length(text)").count() == 0
    assert kept[2] == clean - {200, 201}
    assert kept[3] <= kept[2] and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(tuple, docs.collect()))
    assert hashlib.sha256(b"").hexdigest() not in {r[2] for r in whole}

"""The registered queries as they are, over small tables: columns, contracts, SQL and brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bytes_bpe, queries

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_lattice": ["vec_id", "n_links", "component_id", "kept"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_wavelet": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_bytes_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}
WORDS = [f"{a}{b}{c}" for a, b, c in itertools.product(["ba", "no", "ri", "ta", "le"], ["mu", "ko", "si", "da"], ["", "n", "s", "re"])]


def texts():
    rng = random.Random(11)
    out = []
    for k in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randint(200, 400) if k % 3 else rng.randint(1, 40))]
        if k % 6 == 0:
            words.insert(rng.randrange(len(words) + 1), "grobnik zwelfer")
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        if k % 9 == 0:
            lines.insert(1, rng.choice(["Subscribe NOW", "  subscribe now\t"]))
        out.append("\n".join(lines))
    for k in range(30):
        words = out[1].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        out.append(" ".join(words))
    return out + [None, "", " \n\t\n", "a", "a b c d", "x" * 30_000, out[2], out[2], "one\n\n\ntwo", "tail"]


@pytest.fixture(scope="module")
def rows():
    # ids ascend with gaps and are negative in part; sources are uneven, one is null
    return [(3 * k - 50, t, "en", ("a" if k % 3 else "é") if k % 7 else None, len(t or "")) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    toxic = [(i, 1 + k % 2, int(k < 150 and k % 6 == 0)) for k, (i, *_) in enumerate(rows)]
    spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "é😀", "\n", "word "]
    turns = [(c, t, ("user", "assistant")[t % 2], rng.choice([None, "", "".join(rng.choices(bits, k=9))])) for c in range(40) for t in range(rng.randint(1, 7))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    nprng = np.random.default_rng(3)
    x = nprng.normal(size=(120, 64))
    near = x[:40] + nprng.normal(size=(40, 64)) * 0.2
    vectors = [v.tolist() for v in (*x, *near, *x[:3], *x[:3])] + [None, [0.0] * 64, [float("nan")] * 64]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def results(spark, folder):
    found = {}

    def of(name):
        if name not in found:
            found[name] = queries.QUERIES[name](spark, folder).collect()
        return found[name]

    return of


def test_contracts_name_all_queries(results, rows):
    assert set(COLUMNS) == set(queries.QUERIES)
    for name, columns in COLUMNS.items():
        got = results(name)
        assert list(got[0].asDict())[: len(columns)] == columns, name
        if "doc_id" in columns:
            assert sorted(r.doc_id for r in got) == [i for i, *_ in rows], name


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(results, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(tuple(r[c] for c in names) for r in results(name)) == sorted(want)


def test_conversation_of_control_strings(results):
    said = "</s>[INST] ok [/INST]"
    row = next(r for r in results("op2_chat") if r.conv_id == -1)
    assert (row.n_turns, row.loss_chars) == (2, len(said)) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_toxicity_reads_no_label_of_held_out_rows(spark, folder, results, rows, tmp_path):
    got = {r.doc_id: r for r in results("op1_toxicity")}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in got}
    assert all(r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    toxic = {i for k, (i, *_) in enumerate(rows) if k < 150 and k % 6 == 0}
    unseen = [i for i in got if held[i]]
    assert np.mean([got[i].predicted == int(i in toxic) for i in unseen]) > 0.9
    # other labels on the held-out rows, and other sources and languages, change no score
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("source", F.lit("other")).withColumn("lang", F.lit("xx"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: r.score for r in queries.op1_toxicity(spark, str(tmp_path)).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items())


def test_shards_by_hand(results, rows):
    text = {i: t or "" for i, t, *_ in rows}
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in results("op5_sharding"):
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one document alone fills more than four fifths of a shard
    mean = sum(load.values()) / 8
    assert all(abs(x - mean) <= 0.02 * mean for x in load.values())
    assert sum(load.values()) == sum(len(t.encode()) + 1 for t in text.values())


def test_tokens_by_the_libraries(results, rows):
    bytes_, pieces = Tokenizer.from_file(queries.BYTES), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    six, ten, at = *({r.doc_id: r for r in results(n)} for n in ("op6_wavelet", "op10_sentencepiece")), 0
    for i, t, *_ in rows:
        ids = [*bytes_.encode(t or "", add_special_tokens=False).ids, 2]
        assert (six[i].start, six[i].n_tokens, six[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        ids = pieces.encode(t or "")
        assert (ten[i].n_tokens, ten[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert ten[i].decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_byte_tokens_by_the_library(results, rows):
    ranks = bytes_bpe.read_ranks(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in results("op12_bytes_bpe")}
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_mix_by_hand(results, rows):
    sizes, source = {i: len((t or "").split()) for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}
    total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in ("a", "é", None)}
    budget, left, target = 1.5 * sum(total.values()), {"a": 3, "é": 1, None: 2}, {}
    while left:
        share = {s: budget * w / sum(left.values()) for s, w in left.items()}
        full = [s for s in left if share[s] > 2 * total[s]]
        for s in full or list(left):
            target[s] = 2 * total[s] if full else share[s]
            budget -= target[s] if full else 0
            del left[s]
    taken = collections.Counter()
    for r in results("op8_mixing"):
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1.01 for s in total)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_likeness_against_true_similarity(results, rows):
    got, n = {r.doc_id: r for r in results("op9_fingerprints")}, len(rows)
    errors, prints = [], {}
    for k, (i, t, *_) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % n][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint and prints.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint
        for found, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= found <= 1 and (found == 1 or t != other)
            if min(len(a), len(b)) > 150:
                errors.append(found - true)
    assert len(errors) > 100 and abs(np.mean(errors)) < 0.03 and np.mean(np.abs(errors)) < 0.08

"""Each operator against brute force, on texts with the awkward cases, and on tables that are empty or have extra columns."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
P = public_tokenizers

from loxodrome.llm import (  # noqa: E402
    components,
    op01_ego_join,
    op02_token_counts,
    op03_minhash,
    op04_decontamination,
    op05_sharding,
    op06_token_files,
    op07_byte_bpe,
    op08_toxicity,
    op09_chat,
    op10_licenses,
)
from loxodrome.llm.workspace import Workspace  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside: extra columns of these names must not matter.
CLASH = ("id", "n", "node", "component", "sketch", "h", "b", "rank", "place", "digest", "_line", "copy", "spans", "score", "vector")


def awkward_texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(80)
    near = base.split(" ")
    near[5] = "changed"
    texts = [None, "", " \n\t ", "a", "a b", "A  B\r\nc", base, base, base.upper(), " ".join(near), say(3), say(14), "x" * 3000, "日本語 テスト. ①", say(4000), "don't  stop\n\n now", "<|endoftext|> <s> [x]"]
    return list(enumerate(texts)) + [(6, base), (40, "a"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(awkward_texts(), "doc_id long, text string")
    return d.withColumns({c: F.lit("x") for c in CLASH}).withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "s0").when(F.col("doc_id") % 3 == 1, "s1"), "lang": F.lit(None).cast("string")})


def nothing(df):
    return df.filter("false")


def test_token_counts(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = op02_token_counts.token_counts(docs, path, 40).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 40) for i, t in awkward_texts()]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert op02_token_counts.token_counts(nothing(docs), path, 40).count() == 0


def test_transducer_chunks_compose_in_any_grouping():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    model, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), op02_token_counts.piece_counter(path), random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["  ", " ", "a", "the", "ing", "\n", "é", "①", "▁", "   ", "z"]) for _ in range(rng.randint(1, 25)))
        s = "▁" + t.replace(" ", "▁")
        want = len(model.encode(t))
        assert {counter.count(s, c) for c in (2, 3, 7, 1 << 16)} == {want}
        last = counter.scan([counter.chunk_map(s[i : i + 4]) for i in range(0, len(s), 4)])[-1]
        assert counter.run(counter.start, last.head)[1] + last.body == want
        assert {int(counter.count_column(pa.array([" " + t.replace("▁", " ")]), c)[0]) for c in (4, 5, 7, 1 << 16)} == {want}


def test_transducer_forgets_and_goes_on():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    model, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), op02_token_counts.piece_counter(path), random.Random(4)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    held, counter._max = counter._max, 50
    try:
        assert counter.count_column(pa.array([" " + t, "", " a b"])).tolist() == [len(model.encode(t)), 0, 2]
    finally:
        counter._max = held
        counter.reset()


def test_byte_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=op07_byte_bpe.read_ranks(path), special_tokens={})
    ids = lambda t: np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = op07_byte_bpe.encode_decode(docs, path, P.PATTERN).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(i, len(ids(t)) // 4, sha(ids(t)), sha((t or "").encode())) for i, t in awkward_texts()], key=str)
    assert op07_byte_bpe.encode_decode(nothing(docs), path, P.PATTERN).count() == 0
    codec, rng = op07_byte_bpe.ByteBpe.load(path, P.PATTERN), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["  ", " ", "a", "the", "\n", "é", " \n", "12", "'s", "%%", "　", "日本"]) for _ in range(rng.randint(0, 20)))
        assert codec.encode(t) == ids(t) and codec.decode(ids(t)).decode() == t
        o = codec.open(t[:7])
        o.append(t[7:])
        o.replace(1, 3, "the x")
        assert o.ids() == enc.encode_ordinary(t[:1] + "the x" + t[3:])


def test_edits_cut_and_encode_near_by_only():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    codec, rng = op07_byte_bpe.ByteBpe.load(path, P.PATTERN), random.Random(8)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=op07_byte_bpe.read_ranks(path), special_tokens={})
    parts = ["  ", " ", "a", "the", "\n", "é", " \n", "12", "'s", "%%", "　", "日本", "'", "ll", "word " * 20]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(60))
        o = codec.open(t)
        for _ in range(4):
            a = rng.randint(0, len(o.text))
            b, new = min(len(o.text), a + rng.randint(0, 5)), "".join(rng.choice(parts[:-1]) for _ in range(rng.randint(0, 2)))
            want = o.text[:a] + new + o.text[b:]
            cut = o.replace(a, b, new)
            assert o.text == want and o.ids() == enc.encode_ordinary(want)
            assert cut < 40


def test_prefix_table_edits_agree_with_fresh_tables():
    codec, rng = op07_byte_bpe.ByteBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(6)
    from loxodrome.llm.bpe_dp import PrefixTable

    for _ in range(100):
        s = bytes(rng.choice(b"the and ing") for _ in range(400))
        table = PrefixTable(codec.vocabulary, s)
        computed = table.edit(20, 23, b"xy")
        assert table.last == PrefixTable(codec.vocabulary, s[:20] + b"xy" + s[23:]).last
        assert computed < 390


def test_token_files(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    model = tokenizers.Tokenizer.from_file(path)
    out = op06_token_files.packed_tokens(docs, path, 2, file_rows=5).orderBy("start").collect()
    at, want = 0, []
    for i, t in sorted(awkward_texts(), key=lambda r: (r[0] is not None, r[0] or 0)):  # rows of one id are equal here
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=str) == sorted(((i, n, c) for i, _, n, c in want), key=str)
    assert [r.doc_id for r in out] == [i for i, *_ in sorted(want, key=key)]
    assert op06_token_files.packed_tokens(nothing(docs), path, 2).count() == 0


def test_word_encoder_cuts_where_the_model_does():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    model, encoder, rng = tokenizers.Tokenizer.from_file(path), op06_token_files.WordEncoder.load(path), random.Random(2)
    parts = ["  ", " ", "a", "The", "'S", "'s", "-", "é", "É", "J\u030c", "k\u0308", "\n", "\t", "1", "23", "...", "<|endoftext|>", "日本", "ß", "İ", "Σ", "'", "don't", "\u00a0", "　", "A.", "x-'s", "½", "ﬁ", ".\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    ids = encoder.encode(pa.array(texts))
    for t, a, n in zip(texts, ids.starts.tolist(), ids.sizes.tolist(), strict=True):
        assert ids.flat[a : a + n].tolist() == model.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 300, 2)]

    class Sink(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    sink = Sink()
    w = op06_token_files.PackedWriter(sink, bits, block_ids=100)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    r = op06_token_files.PackedReader(pa.BufferReader(sink.data))
    for i in (3, 0, 4, 1, 2):
        assert (r[i] == docs[i]).all()
    assert [(s.tolist(), x.tolist()) for s, x in r.blocks()] == [([0, 1, 5, 300], np.concatenate(docs[:4]).tolist()), ([2], docs[4].tolist())]


def brute_sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def union_find(links, vertices):
    up = {v: v for v in vertices}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize(("limit", "block"), [(512, 512), (2, 2)])
def test_minhash(spark, limit, block):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    rows = [r for r in awkward_texts() if r[0] is not None]
    for g in range(6):  # groups of near copies with growing numbers of changes
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 7)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    sets = brute_sets(rows, 3)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = union_find(links, ids)
    out = op03_minhash.near_duplicates(d, k=3, threshold=85, limit=limit, block=block).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(i, len(sets[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("few", [500_000, -1])  # ids are broadcast, or shuffled
def test_minhash_ids_with_several_texts(spark, monkeypatch, few):
    monkeypatch.setattr(op03_minhash, "BROADCAST_IDS", few)
    rng = random.Random(3)
    say = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(100)]
    a, b, c, other = say(), say(), say(), say()
    near = lambda w: " ".join([*w[:50], "changed", *w[51:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(other)), (4, None), (4, " ".join(other)), (5, None), (None, " ".join(c)), (7, near(c)), (8, " ".join(c)), (None, near(other))]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
        out = op03_minhash.near_duplicates(d, k=3, threshold=85).collect()
        got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in out)
        assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 3, (5, 5, True): 1, (None, None, False): 2, (7, 7, True): 1, (8, 7, False): 1}
    kept = op03_minhash.keep_first(d, k=3, threshold=85)
    assert kept.columns == d.columns
    want = [(1, " ".join(a)), (1, " ".join(b)), (4, " ".join(other)), (4, None), (5, None), (7, near(c))]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(want, key=str)


def test_minhash_crowds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(150)]
    rows = [(i, " ".join([f"x{i}" if j == i % 150 else w for j, w in enumerate(base)])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{rng.randrange(9999)}" for _ in range(60))) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = op03_minhash.near_duplicates(d, k=3, threshold=85, limit=16, block=16).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(i, 0 if i < 1000 else i) for i, _ in rows}
    assert op03_minhash.sketch_miss(0.85, 0.70) < 1e-8


def test_minhash_of_nothing(spark, docs):
    assert op03_minhash.near_duplicates(nothing(docs)).count() == 0
    assert op03_minhash.near_duplicates(docs.filter("doc_id < 3")).filter("kept").count() == 3
    assert op03_minhash.miss_probability(0.85, 10, 8) < 1e-6


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    out = components.connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark)).collect()
    vertices = {x for e in edges if e[0] != e[1] for x in e}
    assert {(r.id, r.component) for r in out} == set(union_find([e for e in edges if e[0] != e[1]], vertices).items())


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(scale=s, size=16)], g % 3) for k, s in enumerate([0, 0, 0.05, 0.1, 0.3])]
    same = rows[0][1]
    n = len(rows)
    odd = [(n, same, 0), (n + 1, [2 * x for x in same], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, same, None), (n + 6, [None] * 16, 1), (n + 7, [float("inf")] + [0.0] * 15, 1), (n + 8, [1.0, 2.0], 0), (n + 9, [], 0)]
    rows += odd
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASH + ("key", "seq", "cell", "x", "pair")})
    ok = {i: np.array(v, float) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    cos = lambda a, b: len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and cos(ok[a], ok[b])]
    root, degree = union_find(links, [r[0] for r in rows]), collections.Counter(x for e in links for x in e)
    for interval in (1024, 7):
        out = op01_ego_join.embedding_links(d, interval=interval).collect()
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out} == {(i, degree[i], root[i], root[i] == i) for i, _, _ in rows}
    assert op01_ego_join.embedding_links(nothing(d)).count() == 0


def test_embedding_ids_with_several_vectors(spark):
    rng = np.random.default_rng(5)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    rows = [(5, a, "x"), (3, b, "x"), (5, b, "x"), (9, a, "x"), (7, c, "x"), (7, c, "y"), (None, c, "x"), (None, a, "x")]
    for kind in ("string", "binary", "double"):
        label = F.when(F.col("label") == "x", 1.5).otherwise(-0.0) if kind == "double" else F.col("label").cast(kind)
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("label", label)
        out = op01_ego_join.embedding_links(d).collect()
        assert sorted(map(tuple, out), key=str) == sorted([(5, 1, 3, False), (3, 1, 3, True), (5, 1, 3, False), (9, 1, 3, False), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, False), (None, 0, None, False)], key=str)


@pytest.mark.parametrize("cosine", [1.0, 0.9999, 0.98, 0.5])
def test_embedding_crowds(spark, cosine):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=8)
    rows = [(i, (middle + rng.normal(scale=s, size=8)).tolist(), 0) for i, s in enumerate([1e-4] * 60 + [0.02] * 60 + [1.0] * 60)] + [(180, (2 * middle).tolist(), 0), (181, (4 * middle).tolist(), 0)]
    x = np.array([v for _, v, _ in rows])
    c = (x[:, None] * x).sum(-1) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
    linked = c >= cosine
    np.fill_diagonal(linked, False)
    root = union_find(np.argwhere(linked).tolist(), range(len(rows)))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for interval in (16, 1024):
        out = op01_ego_join.embedding_links(d, cosine=cosine, interval=interval).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(i, int(linked[i].sum()), root[i]) for i in range(len(rows))}


@pytest.mark.parametrize("index_bytes", [1 << 20, 150])
def test_decontamination(spark, docs, monkeypatch, index_bytes):
    monkeypatch.setattr(op04_decontamination, "INDEX_BYTES", index_bytes)
    texts = dict(r for r in awkward_texts() if r[0] is not None)
    w = re.findall(r"\w+", texts[14])
    items = [(0, " ".join(w[50:80])), (1, " ".join(w[60:73])), (2, texts[3]), (3, None), (4, "..."), (5, " ".join(w[50:80])), (6, " ".join(w[70:72])), (None, " ".join(w[0:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        v = split(t)
        m = min(13, len(v))
        for a in range(len(v) - m + 1 if m else 0):
            windows[tuple(v[a : a + m])].add("" if i is None else str(i))
    want = []
    for i, t in awkward_texts():
        v, hit, found = split(t), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(v) - m + 1):
                if tuple(v[a : a + m]) in windows:
                    hit.update(range(a, a + m))
                    found |= windows[tuple(v[a : a + m])]
        want.append((i, len(v), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(v)))
    out = op04_decontamination.contamination(docs, bench).collect()
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    clean = op04_decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([i for i, *_, c in want if not c], key=str)
    assert op04_decontamination.contamination(docs, nothing(bench)).filter("n_hit > 0").count() == 0
    assert op04_decontamination.contamination(nothing(docs), bench).count() == 0


@pytest.mark.parametrize("index_bytes", [1 << 20, 150])
def test_decontamination_judges_rows_not_ids(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(op04_decontamination, "INDEX_BYTES", index_bytes)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(13))) for i in range(6)]
    bad, good = items[0][1], "nothing of the benchmark"
    rows = [(None, bad), (None, good), (None, None), (1, items[3][1]), (1, good), (1, good), (2, bad), (2, bad), (3, good)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    clean = op04_decontamination.keep_clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == d.columns
    want = [(None, good), (None, None), (1, good), (1, good), (3, good)]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=str) == sorted(want, key=str)


def test_sharding(spark, docs):
    out = op05_sharding.stratified_shards(docs, 4, bucket_rows=3).collect()
    assert len(out) == len(awkward_texts())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in awkward_texts()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert op05_sharding.stratified_shards(nothing(docs), 4).count() == 0


def test_sharding_by_its_definition(spark, docs):
    """Places recomputed in plain Python: ranks of hashes within sources, sorted by fractional rank, cut evenly."""
    draw = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:13], 16) / (1 << 52)
    rows = [(i, t, None if i is None or i % 3 == 2 else f"s{i % 3}") for i, t in awkward_texts()]
    all_, by = [], collections.defaultdict(list)
    for i, t, s in rows:
        raw, src = (t or "").encode(), "-" if s is None else "s" + s
        crc = zlib.crc32(raw)
        by[src].append((draw(17, "null" if i is None else i, crc, src), (i is not None, i or 0), len(raw), crc))
    for src, of in by.items():
        of.sort()
        all_ += [((k + draw(18, src)) / len(of), src, h, i, n, crc) for k, (h, i, n, crc) in enumerate(of)]
    all_.sort()
    want, n = [], len(all_)
    for place, (_, _, _, i, size, crc) in enumerate(all_):
        shard = place * 4 // n
        want.append((i[1] if i[0] else None, size + 1, crc, shard, place - -(-shard * n // 4)))
    out = op05_sharding.stratified_shards(docs, 4, bucket_rows=3).collect()
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out], key=str) == sorted(want, key=str)


def test_sharding_mixture(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    out = op05_sharding.stratified_shards(d, 8)
    again = op05_sharding.stratified_shards(d.repartition(7), 8)
    assert out.exceptAll(again).count() == 0
    for r in out.groupBy("source").pivot("shard", list(range(8))).count().na.fill(0).collect():
        n = [r[str(i)] for i in range(8)]
        assert max(n) - min(n) <= 4


def test_toxicity(spark):
    rng = random.Random(4)
    plain = ["word%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["idiotic", "idiots", "scum"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, " . \n"), (1003, "x" * 100_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH if c != "score"} | {"label": F.lit(1)})
    y = spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("scum"))
    model = op08_toxicity.fit(d, y)
    out = {r.doc_id: r for r in op08_toxicity.score(d, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [i for i, _ in labels if out[i].held_out]
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.95
    assert out[1000].score == out[1001].score == out[1002].score == 0.0 and 0 <= out[1003].score <= 1
    spans = op08_toxicity.offending_sentences("all fine here. you are scum today. fine", model)
    assert [("all fine here. you are scum today. fine".encode()[a:b]) for a, b, _ in spans] == [b"you are scum today"]
    kept = op08_toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    none = op08_toxicity.fit(d, nothing(y))
    assert op08_toxicity.score(d, none).filter("score > 0").count() == 0
    assert op08_toxicity.score(nothing(d), model).count() == 0


def test_toxicity_scores_by_their_definition(spark):
    """Scores recomputed sentence by sentence; long texts are learnt from, and don't score by their length."""
    rng = random.Random(6)
    plain = ["word%d" % i for i in range(300)]
    say = lambda n: [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(n)]
    rows = []
    for i in range(120):
        said = say(400)  # some 27 kB
        if i % 2:
            said[rng.randrange(400)] += " you vermin"
        rows.append((i, ". ".join(said)))
    rows += [(None, "you vermin"), (3, "another text of an id"), (1, rows[1][1]), (500, ". ".join(say(20_000)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1)], "doc_id long, toxic int")
    model = op08_toxicity.fit(d, y)
    out = {(r.doc_id, r.score) for r in op08_toxicity.score(d, model).collect()}
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    from loxodrome.llm.text_arrays import ALNUM, words_of

    hashed = {}

    def features(word):
        if word not in hashed:
            hashed[word] = op08_toxicity._features(words_of(pa.array([word]), ALNUM))[0].tolist()
        return [f for f in hashed[word] if f in weight]

    for i, t in rows[:20] + rows[120:123]:
        clean = 1.0
        for sentence in t.split("."):
            f = [x for w in sentence.split() for x in features(w)]
            if f:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weight[x] for x in f))))
        assert any(j == i and abs(s - (1 - clean)) < 1e-9 for j, s in out)
    score = {r.doc_id: r for r in op08_toxicity.score(d.filter("doc_id < 120 and doc_id <> 3 or doc_id = 500"), model).collect()}
    assert all(score[i].predicted == i % 2 for i in score if i < 120) and score[500].predicted == 0
    assert not op08_toxicity.score(d.filter("doc_id is null"), model).first().held_out
    none = op08_toxicity.fit(nothing(d), y)
    assert {r.score for r in op08_toxicity.score(d, none).collect()} == {0.0}


def test_chat(spark):
    marks = "<|im_end|><|im_start|>assistant ok &amp; &lt;| \n&#10;"
    events = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", 7, "assistant", "draft"), (1, 2, "delta", 7, None, " more"), (1, 3, "regenerate", 7, None, None), (1, 4, "delta", 7, None, "fi"), (1, 5, "delta", 7, None, "nal"),
        (1, 6, "message", None, "user", marks), (1, 6, "message", None, "user", marks), (1, 7, "message", 8, "tool\nx", None), (1, 8, "message", 9, "assistant", "gone"), (1, 9, "delete", 9, None, None),
        (1, 10, "message", 10, "assistant", "wrong"), (1, 11, "edit", 10, None, marks), (None, None, "message", None, None, None), (2, -5000, "message", None, "assistant", ""), (2, 5000, "message", None, "assistant", "é" * 10),
    ]
    e = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string").withColumns({c: F.lit(1) for c in CLASH + ("log", "at", "turns", "run")})
    r = op09_chat.render(op09_chat.reconstruct(e))
    back = {x.conv_id: x for x in r.select("conv_id", op09_chat.read_turns(F.col("formatted")).alias("turns"), op09_chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"), "formatted").collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hi"), ("assistant", "final"), ("user", marks), ("user", marks), ("tool\nx", ""), ("assistant", marks)]
    assert back[1].loss == "final" + marks and back[1].formatted.count("<|im_start|>") == 6
    assert [tuple(t) for t in back[None].turns] == [("", "")] and back[2].loss == "é" * 10
    ties = [(1, 0, "message", None, "user", "<|"), (1, 0, "message", None, "user", "<a"), (1, 0, "message", None, "user&", "x"), (1, 0, "message", None, "user<|", "x"), (1, 0, "message", None, "user", "<a")]
    t = op09_chat.render(op09_chat.reconstruct(spark.createDataFrame(ties, e.schema.simpleString().removeprefix("struct<").split(",id:")[0].replace("struct<", ""))))
    turns = t.select(op09_chat.read_turns(F.col("formatted")).alias("turns")).first().turns
    assert [tuple(x) for x in turns] == sorted((r, x) for *_, r, x in ties)
    d = {x.conv_id: x for x in op09_chat.digest(r).collect()}
    assert (d[2].n_turns, d[2].loss_chars) == (2, 10)
    assert op09_chat.digest(op09_chat.render(op09_chat.reconstruct(nothing(e)))).count() == 0
    with pytest.raises(Exception, match="unknown event kind"):
        op09_chat.reconstruct(e.withColumn("kind", F.lit("what"))).collect()


def test_licenses(spark, docs):
    mit = next(t for n, t in op10_licenses.KNOWN if n == "MIT")
    varied = "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + mit.replace("Software", "SOFTWARE").replace("\n\n", "\n  ").replace('"', "“")
    apart = [(9, "Released under the MIT License"), (9, "nothing"), (None, "x\nSPDX-License-Identifier: MPL-2.0"), (None, "y")]
    both = spark.createDataFrame(apart, "doc_id long, text string")
    assert {(r.doc_id, r.line_licenses) for r in op10_licenses.license_scan(both).collect()} == {(9, "MIT"), (9, ""), (None, "MPL-2.0"), (None, "")}
    rows = [(0, varied), (1, "prose\nReleased under the MIT Licence!\nmore prose"), (2, None), (3, ""), (4, mit + " extra"), (0, varied), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License"), (6, mit.replace("sublicense", "sub\n licence")), (7, op10_licenses._UNLICENSE.replace("non-commercial", "non\ncommercial"))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH + ("license", "line_licenses", "text_digest")})
    out = op10_licenses.license_scan(d).collect()
    assert sorted([(r.doc_id, r.text_license, r.line_licenses) for r in out], key=str) == sorted(
        [(0, "MIT", ""), (0, "MIT", ""), (1, None, "MIT"), (2, None, ""), (3, None, ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (6, "MIT", ""), (7, "Unlicense", "")], key=str
    )
    assert op10_licenses.license_scan(nothing(d)).count() == 0
    assert op10_licenses.license_scan(docs).count() == len(awkward_texts())
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = sorted({(i, a, b, c) for i, a, b, c in con.sql(op10_licenses.oracle_sql()).fetchall()}, key=str)
    assert sorted({(r.doc_id, r.text_digest, r.text_license, r.line_licenses) for r in out}, key=str) == want


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "MPL-2.0", "CC0-1.0"])
def test_licenses_of_whole_files(spark, name):
    from pathlib import Path

    file = Path("/usr/share/common-licenses", name)
    if not file.exists():
        pytest.skip("no licence files here")
    d = spark.createDataFrame([(1, "  " + file.read_text().replace("\n", "\r\n"))], "doc_id long, text string")
    assert op10_licenses.license_scan(d).first().text_license == {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}.get(name, name)


def test_shared_folder_must_be_named_on_a_cluster():
    from loxodrome.llm.workspace import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="must name a folder"):
        shared_dir(Session())

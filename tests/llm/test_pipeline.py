import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402


def test_stages_filter_and_keep(spark, tmp_path):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(30)) for i in range(3)]
    rows = [(i, say(60)) for i in range(200)]
    toxic = {i for i in range(0, 200, 5)}
    rows = [(i, t + (" such scum. you scum idiot" if i in toxic else "")) for i, t in rows]
    rows += [(300, rows[1][1]), (301, rows[1][1] + " extra"), (302, bench[0][1] + " " + say(20)), (303, say(5000) + " " + bench[1][1]), (304, None), (305, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in out}
    assert set(got) == {i for i, _ in rows} - toxic - {300, 301, 302}
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i in got)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, bench, rejected):
    """The four stages by their definitions, over rows of (id, text); which rows the first rejects is given."""
    import base64
    import re

    import public_tokenizers as P
    import tiktoken

    rows = [r for r in rows if not rejected(r[1] or "")]
    shingles = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        shingles.append(frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if shingles[i] and shingles[j] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                group[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    firsts = {g: min(m, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g, m in members.items()}
    rows = [r for i, r in enumerate(rows) if not shingles[i] or firsts[root(i)] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(ws[i : i + 13]) for _, t in bench if (ws := words(t)) for i in range(max(1, len(ws) - 12))}
    kept = []
    for i, t in rows:
        ws = words(t)
        hit = {p for n in {len(w) for w in windows} for a in range(len(ws) - n + 1) if tuple(ws[a : a + n]) in windows for p in range(a, a + n)}
        if not hit or 20 * len(hit) < len(ws):
            kept.append((i, t))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in kept:
        ids = codec.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_all_stages_recomputed(spark, tmp_path):
    """Null and repeated ids, clashing columns, near copies in chains, contaminated and toxic rows."""
    from collections import Counter

    from loxodrome.llm import op08_toxicity

    rng = random.Random(21)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(30)) for i in range(4)] + [(4, "w1 w2 w3"), (5, None)]
    rows = [(i, say(rng.choice([3, 40, 90])) + (" Such scum! You scum idiot." if i % 4 == 0 else "")) for i in range(160)]
    base = say(100).split(" ")
    chain = [" ".join(base[:-k] if k else base) for k in (0, 10, 20, 30)]
    rows += [(200 + k, t) for k, t in enumerate(chain)] + [(300, chain[1].upper()), (None, chain[0]), (None, say(50)), (None, say(60)), (7, say(45)), (7, rows[7][1]), (None, None), (None, "")]
    rows += [(400, bench[0][1] + " " + say(30)), (401, say(900) + " " + bench[1][1]), (None, bench[2][1]), (402, "x w1 w2 w3 y"), (403, say(700) + " such scum. you scum idiot")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    d = d.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), **{c: F.lit("own") for c in ("_id", "_hash", "_row", "id", "group", "h", "score")}})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = op08_toxicity.fit(d, labels)
    scores = op08_toxicity.score(spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "doc_id long, text string"), model, threshold=0.7).collect()
    rejected = {rows[r.doc_id][1] or "" for r in scores if r.score >= 0.7}
    assert 30 < len(rejected) < 60
    want = plain(rows, bench, rejected.__contains__)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    at = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns, name
    assert at.filter("_id <> 'own' or _hash <> 'own' or _row <> 'own'").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

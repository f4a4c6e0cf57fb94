"""Alignment, filter audit and line dedup against brute force on awkward tables, and their two paths against each other."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from loxodrome.llm import op11_alignment, op12_filter_audit, op13_line_dedup  # noqa: E402

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns of names that the operators use inside.
CLASH = ("id", "row", "pair", "n", "digest", "mask", "part", "first", "good", "block", "hash", "last", "best", "drops")


def cluttered(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASH})


def odd_texts():
    rng = random.Random(11)
    bits = ["  ", " ", "a", "the", "ing", "\n", "é", "①", "   ", "z", "don't", "日本", " ", "\t", "<|endoftext|>", "<s>", "1234", "😀", ".", " ", "\x00", "ſ", "_x"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return [None, "", " ", "  ", "\n", "a", "▁", "x ▁ y", "same text", "same text", "trailing  ", "x" * 5000, *made, " ".join(rng.choice(made) for _ in range(400))]


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def aligned(texts):
    """By the definition: every pair of spans is looked at that can overlap."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = op11_alignment.byte_level()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and {b"".join(names[i] for i in ia), b"".join(map(piece, ib))} != {(" " + t).encode()}:
            ia, ib = [], []
        sa, sb = spans([names[i] for i in ia]), spans([piece(i) for i in ib])
        links = [(ia[i], ib[j]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y] if len(sa) < 2000 else None
        if links is None:
            links, j = [], 0
            for i, (x, y) in enumerate(sa):
                while sb[j][1] <= x:
                    j += 1
                k = j
                while k < len(sb) and sb[k][0] < y:
                    links.append((ia[i], ib[k]))
                    k += 1
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, ka, kb = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ka < len(sa) and sa[ka][1] <= c:
                ga.append(str(ia[ka]))
                ka += 1
            while kb < len(sb) and sb[kb][1] <= c:
                gb.append(str(ib[kb]))
                kb += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        rows.append((len(ia), len(ib), groups, links))
    count = Counter(x for r in rows for x in r[3])
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [
        (n_a, n_b, len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for n_a, n_b, g, x in rows
    ]


@pytest.mark.parametrize("pairs_sent", [op11_alignment.PAIRS_SENT, 0])
def test_alignment(spark, pairs_sent):
    texts = odd_texts()
    ids = [*range(len(texts) - 2), 3, None]
    df = cluttered(spark, list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    out = op11_alignment.alignment(df, A_FILE, B_FILE, pairs_sent=pairs_sent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *r) for i, r in zip(ids, aligned(texts), strict=True)]
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert sum(w[1] > 0 for w in want) > 250 and sum(w[1] == 0 for w in want) == 4
    assert op11_alignment.alignment(df.filter("false"), A_FILE, B_FILE, pairs_sent=pairs_sent).count() == 0


def test_alignment_of_nothing_but_nulls(spark):
    out = op11_alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_FILE, B_FILE).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_align_counts_by_byte():
    found = op11_alignment.align(np.array([2, 3, 1, 4]), np.array([1, 1, 4, 4]), np.array([6, 0, 4]))
    assert found.groups.tolist() == [2, 0, 1] and found.links.tolist() == [4, 0, 1]
    assert found.link_a.tolist() == [0, 0, 1, 2, 3] and found.link_b.tolist() == [0, 1, 2, 2, 3]
    assert found.group_a.tolist() == [0, 1, 1, 2] and found.group_b.tolist() == [0, 0, 1, 2]


def audited(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    firsts = {}
    for i, _, t in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)

    def fails(i, t):
        for c in "\t\n\x0b\x0c\r":
            spaced = t.replace(c, " ")
            t = spaced
        ws = [w for w in t.split(" ") if w]
        return {c for c, f in zip("ABCD", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t)), strict=True) if f}

    known = [(p or "", fails(i, t or "") | ({"E"} if i is not None and i > firsts[t or ""] else set()), i in good, i in toxic) for i, p, t in rows]
    out = []
    for part in {p for p, *_ in known}:
        mine = [x for x in known if x[0] == part]
        block = []
        for order in permutations("ABCDE"):
            for s, c in enumerate(order):
                before = set(order[:s])
                gone = [x for x in mine if c in x[1] and not before & x[1]]
                block.append((part, "".join(order), s + 1, sum(not (before | {c}) & x[1] for x in mine), len(gone), sum(c in x[1] and bool(before & x[1]) for x in mine), sum(x[1] == {c} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        total = Counter()
        for b in block:
            total[b[1][b[2] - 1]] += b[4]
        out += [(*b, total[b[1][b[2] - 1]]) for b in block]
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    say = lambda n, pool=words: " ".join(rng.choice(pool) for _ in range(n))
    texts = [None, "", "A", "x y", say(250), say(250).upper(), say(300, words[:20]), say(260) + " 5%", "a\tb\x0bc\r\n" + say(198), say(199), say(200), say(5000)]
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(60)] + [(None, "en", texts[4]), (None, None, None), (3, "fr", texts[4]), (3, "fr", texts[4])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = cluttered(spark, rows, "doc_id long, lang string, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("y") for c in ("id", "good", "mask", "n", "text", "lang")})
    out = op12_filter_audit.audit(df, lab)
    assert out.columns == [c.split()[0] for c in op12_filter_audit.SCHEMA.split(", ")]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == set(audited(rows, labels))
    assert op12_filter_audit.audit(df.filter("false"), lab).count() == 0
    assert {tuple(r) for r in op12_filter_audit.audit(df, lab.filter("false")).collect()} == set(audited(rows, []))


def test_incidence_matrices_partition_the_failing():
    m = op12_filter_audit.incidence()
    assert all(x.shape == (32, 600) for x in m.values())
    assert (m["kept"][0] == 1).all() and (m["removed"][0] == 0).all()
    last = np.arange(4, 600, 5)
    for mask in range(1, 32):
        assert (m["removed"][mask].reshape(-1, 5).sum(1) == 1).all() and (m["kept"][mask][last] == 0).all()


def deduped(rows, shortest, documents):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= shortest and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(h := holders.get(key(x), ())) >= documents and max(h) != i and len(key(x)) >= shortest for x in lines]
        out.append((i, len(lines), sum(drop), hashlib.sha256("\n".join(x for x, d in zip(lines, drop, strict=True) if not d).encode()).hexdigest()))
    return out


def line_rows():
    rng = random.Random(2)
    long = ["line number %d with some more words in it, to be of forty characters" % i for i in range(40)]
    odd = ["é" * 40, "É" * 39 + "x", "é" * 39, "short", "", " \t ", "\x0b" + "k" * 40 + "\r", "K" * 40, "k" * 39, " " + "k" * 39]
    rows = [(i, "\n".join(rng.choice([*long, *odd, f"line of document {i} only, of forty characters or more"]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(long * 30)), (None, long[0] + "\n" + long[1]), (None, None), (5, long[2]), (5, long[2]), (7, "\n\n" + long[3] + "\n")]
    rows += [(300, "only six rows but one document\n" + "q" * 50)] * 6
    return rows


@pytest.mark.parametrize(("bits", "keys_sent"), [(1 << 20, 1000), (1 << 20, 0), (1 << 16, 1000)])
@pytest.mark.parametrize(("shortest", "documents"), [(40, 5), (0, 2)])
def test_line_dedup(spark, bits, keys_sent, shortest, documents):
    rows = line_rows()
    df = cluttered(spark, rows, "doc_id long, text string").repartition(6)
    out = op13_line_dedup.drop_lines(df, shortest, documents, filter_bits=bits, keys_sent=keys_sent)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = deduped(rows, max(1, shortest), documents)
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert sum(w[2] for w in want) > 100
    assert op13_line_dedup.drop_lines(df.filter("false"), shortest, documents, filter_bits=bits, keys_sent=keys_sent).count() == 0


def test_line_dedup_wants_two_documents(spark):
    with pytest.raises(ValueError, match="repeated"):
        op13_line_dedup.drop_lines(spark.createDataFrame([(1, "x")], "doc_id long, text string"), documents=1)


def test_filters_hold_what_two_tasks_have_seen(spark):
    shared = ["shared line %d, of forty characters at the very least" % i for i in range(500)]
    rows = [(i, "\n".join([shared[i % 500], f"own line of document {i}, of forty characters or so at least"])) for i in range(1000)]
    bits = 1 << 20
    blocks = op13_line_dedup.seen_twice(spark.createDataFrame(rows, "doc_id long, text string").select("text").repartition(7), 40, bits).collect()
    assert len({r.block for r in blocks}) == len(blocks) <= bits // op13_line_dedup.BLOCK_BITS
    held = op13_line_dedup.Filter(bits)
    for r in blocks:
        held.packed[r.block * 8192 : (r.block + 1) * 8192] = np.frombuffer(r.twice, np.uint8)
    of = lambda texts: op13_line_dedup.lines_of(pa.array(texts), 40).hashes
    assert held.holds(of(shared)).all()
    assert held.holds(of([t.split("\n")[1] for _, t in rows])).mean() < 0.05


def test_blocks_are_stored_by_positions_or_bits():
    rng = np.random.default_rng(1)
    f = op13_line_dedup.Filter(1 << 17)
    f.add(rng.integers(0, 1 << 16, 30_000).astype(np.uint64))  # the first block is full
    f.add(np.array([(1 << 16) + 5], np.uint64))
    stored = dict(f.blocks())
    assert len(stored[0]) == 8192 > len(stored[1]) > 0
    assert all((op13_line_dedup.block_bits(b) == f.packed[k * 8192 : (k + 1) * 8192]).all() for k, b in stored.items())

"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its words and of their leading
letters, of those that training keeps; a document is toxic unless all its sentences are not:
``P = 1 - prod(1 - sigmoid(s_i))``. A sentence without any kept feature says nothing and has the probability 0, so
that no text gets a score by its length alone. Training maximises the likelihood of document labels under this, so a
toxic document blames the sentences that explain it, and :func:`offending_sentences` finds them.

The model is fit on a bounded sample of labelled rows (``MAX_SAMPLE`` of each label, of any length), picked by a
seeded hash of the id. Executors count their features and list the kept ones by sentence; texts don't reach the
driver. Scoring is one pass over all rows without a shuffle. Only the text is an input of a score.

Defined cases: a null, empty or wordless text has the score of no sentence, 0; repeated rows each get a row (and are
learnt from once); a null id is never learnt from and isn't held out; labels that are null are ignored, contradictory
ones count as toxic; without labels of both kinds, or without rows, all scores are 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.frames import known_texts, long_lists, map_batches, narrow, per_slice, slices
from loxodrome.llm.text_arrays import ALNUM, Words, byte_class, hash_spans, words_of
from loxodrome.llm.workspace import Workspace

#: Leading bytes of a word that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: Labelled rows of each label that training takes.
MAX_SAMPLE = 4000
#: A sentence is cut after so many words, so that text without sentence ends has sentences too.
SENTENCE_WORDS = 24
_ENDS = byte_class(b".!?\n")


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id's decimal text is 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model(NamedTuple):
    """Weights of the features that training kept, by their 64-bit hashes, and the bias of a sentence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    maybe: np.ndarray  # by a key's low bits

    @classmethod
    def of(cls, keys: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(keys, weights, bias, maybe)

    def find(self, features: np.ndarray) -> np.ndarray:
        """Numbers of features from 1; 0 for those without a weight."""
        flat, out = features.ravel(), np.zeros(features.size, np.int32)
        if len(self.keys):
            (i,) = np.nonzero(self.maybe[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.keys, flat[i])
            at[at == len(self.keys)] = 0
            out[i] = np.where(self.keys[at] == flat[i], at + 1, 0)
        return out.reshape(features.shape)


def _features(words: Words) -> np.ndarray:
    """Feature hashes, a row for each word; 0 is no feature."""
    out = np.zeros((len(words.starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = words.hashes
    for k, n in enumerate(PREFIXES):
        h = hash_spans(words.data, words.starts, np.minimum(words.ends, words.starts + n))
        out[:, k + 1] = np.where(words.ends - words.starts >= n, h + np.uint64(7919 * (k + 1)), np.uint64(0))
    return out


def _sentences(words: Words) -> np.ndarray:
    """The first words of sentences."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64)
    seen = np.cumsum(_ENDS[words.data])[words.starts]
    new = np.ones(n, bool)
    new[1:] = (seen[1:] != seen[:-1]) | (words.text[1:] != words.text[:-1])
    (heads,) = np.nonzero(new)
    run = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    return np.nonzero(run % SENTENCE_WORDS == 0)[0]


def _score(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' scores; sentences' first words and probabilities."""
    heads, n = _sentences(words), len(words.first) - 1
    if not len(heads):
        return np.zeros(n), heads, np.zeros(0)
    found = model.find(_features(words))
    says = np.maximum.reduceat(found.max(axis=1), heads) > 0
    logit = np.add.reduceat(np.concatenate([[0.0], model.weights])[found].sum(axis=1), heads) + model.bias
    # -log of the chance that no sentence is toxic
    clean = np.bincount(words.text[heads], np.where(says, np.logaddexp(0, logit), 0.0), minlength=n)
    return np.clip(-np.expm1(-clean), 0, 1), heads, np.where(says, 1 / (1 + np.exp(-logit)), 0.0)


def _counted(rows: DataFrame) -> DataFrame:
    """``feature, docs, toxic``: in how many documents, and toxic ones, each feature stands."""

    def make():
        def work(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            words, y = words_of(texts, ALNUM), batch.column(1).to_numpy()
            features = _features(words)
            f, t = features.ravel(), np.repeat(words.text, features.shape[1])
            order = np.lexsort((t, f))
            f, t = f[order], t[order]
            once = np.ones(len(f), bool)
            once[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
            f, t = f[once], t[once]
            keys, first = np.unique(f, return_index=True)
            docs = np.diff(np.append(first, len(f)))
            toxic = np.add.reduceat(y[t], first) if len(f) else docs
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["feature", "docs", "toxic"])

        return work

    each = per_slice(rows, "feature long, docs long, toxic long", "text", make)
    return each.groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).filter("feature <> 0")


def select(rows: DataFrame, least_docs: int, least_z: float) -> np.ndarray:
    """Features that are in more toxic documents than chance would put there, by ``least_z`` standard deviations."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    if not n["n"] or not 0 < n["toxic"] < n["n"]:
        return np.zeros(0, np.uint64)
    share = n["toxic"] / n["n"]
    z = (F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share))
    kept = _counted(rows).filter((F.col("docs") >= least_docs) & (z >= least_z)).select("feature").orderBy("feature")
    return np.sort(kept.toArrow().column(0).to_numpy().view(np.uint64))


def _listed(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """Of each row its label, and its kept features: numbers from 1, and the sentence of each."""
    empty = Model.of(keys, np.zeros(len(keys)), 0.0)

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(known_texts(batch.column(3))):
                words, n = words_of(part, ALNUM), len(part)
                found = empty.find(_features(words))
                row, column = np.nonzero(found)
                heads = _sentences(words)
                mark = np.zeros(len(found), np.int64)
                mark[heads] = 1
                sizes = np.bincount(words.text[row], minlength=n)
                sentence = (np.cumsum(mark) - 1)[row] - np.searchsorted(words.text[heads], words.text[row])
                lists = [long_lists(x.astype(np.int32), sizes) for x in (sentence, found[row, column])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, n) for k in range(3)), *lists], names=["id", "h", "y", "sentence", "feature"])
                at += n

    return map_batches(rows.select("id", "h", "y", "text"), run, "id long, h long, y int, sentence array<int>, feature array<int>")


def train(labels: np.ndarray, of_text: np.ndarray, sentence: np.ndarray, number: np.ndarray, keys: np.ndarray, steps: int = 3500, rate: float = 0.3, decay: float = 1e-4, batch: int = 64, seed: int = 5) -> Model:
    """Adaptive gradient steps on the bags' likelihood, both labels with equal weight in sum.

    ``of_text`` has each sentence's document, in rising order; ``sentence`` and ``number`` each kept feature's sentence
    (rising) and number from 1.
    """
    n = len(of_text)
    start = np.searchsorted(sentence, np.arange(n + 1))
    first = np.searchsorted(of_text, np.arange(len(labels) + 1))
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    weights = np.zeros(len(keys) + 2)  # the bias first; then the kept features; the last is unused
    weights[0], squares, rng = -4.0, np.full(len(keys) + 2, 1e-6), np.random.default_rng(seed)
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            docs = [d for d in order[lo : lo + batch].tolist() if first[d] < first[d + 1]]
            if not docs:
                continue
            s = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            bag = np.repeat(np.arange(len(docs)), [first[d + 1] - first[d] for d in docs])
            counts = start[s + 1] - start[s]
            which = np.repeat(np.arange(len(s)), counts)
            at = number[np.arange(counts.sum()) + np.repeat(start[s] - (np.cumsum(counts) - counts), counts)]
            logit = np.bincount(which, weights[at], minlength=len(s)) + weights[0]
            clean = np.bincount(bag, np.logaddexp(0, logit))
            pull = np.where(labels[docs] == 1, -np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-9), 1.0) * share[docs] / len(docs)
            slope = pull[bag] / (1 + np.exp(-logit))
            gradient = np.bincount(at, slope[which], minlength=len(weights))
            gradient[0] = slope.sum()
            (hit,) = np.nonzero(gradient)
            g = gradient[hit] + decay * weights[hit]
            squares[hit] += g * g
            weights[hit] -= rate * g / np.sqrt(squares[hit])
    return Model.of(keys, weights[1:-1], float(weights[0]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least_docs: int = 3, least_z: float = 6.0, seed: int = 5
) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    work = Workspace(docs.sparkSession)
    known = narrow(labels, id_col, label_col).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    pick = F.xxhash64(F.lit(seed), "id")
    sample = None
    for y in (0, 1):  # at most 2 * MAX_SAMPLE small rows are broadcast
        part = known.filter(F.col("y") == y).orderBy(pick, "id").limit(MAX_SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    texts = narrow(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    rows = work.save(rows.select("text", "y", "id", "h"), "sample")
    # many texts of one id: so many rows are learnt from as there may be ids
    chosen = rows.select("id", "h").orderBy(pick, "id", "h").limit(2 * MAX_SAMPLE)
    rows = rows.join(F.broadcast(chosen), ["id", "h"]).select("text", "y", "id", "h")
    none = np.zeros(0, np.uint64)
    keys = select(rows, least_docs, least_z)
    if not len(keys):
        work.drop(work.saved[0])
        return Model.of(none, np.zeros(0), 0.0)
    table = _listed(rows, keys).orderBy(pick, "id", "h").select("y", "sentence", "feature").toArrow()
    work.drop(work.saved[0])
    y = table.column("y").to_numpy()
    sizes = np.concatenate([[0], np.cumsum(table.column("sentence").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
    sentence, number = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("sentence", "feature"))
    doc = np.repeat(np.arange(len(y)), np.diff(sizes))
    new = np.ones(len(doc), bool)  # sentences are numbered over all documents, those without a kept feature left out
    new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    return train(y, doc[new], np.cumsum(new) - 1, number, keys, seed=seed)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, held_out, score, predicted for every row."""

    def make():
        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(_score(words_of(texts, ALNUM), model)[0])], names=[id_col, "score"])

        return work

    scored = per_slice(narrow(df, id_col, text_col), f"{id_col} long, score double", text_col, make)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns; one pass."""

    def make():
        return lambda rows, texts: rows.filter(pa.array(_score(words_of(texts, ALNUM), model)[0] < threshold))

    return per_slice(df, df.schema, text_col, make)


def offending_sentences(text: str, model: Model, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """Byte spans (of the UTF-8 text) and probabilities of the sentences that reach ``threshold``."""
    words = words_of(pa.array([text or ""]), ALNUM)
    _, heads, p = _score(words, model)
    last = np.append(heads[1:], len(words.starts)) - 1
    return [(int(words.starts[a]), int(words.ends[b]), float(x)) for a, b, x in zip(heads, last, p, strict=True) if x >= threshold]

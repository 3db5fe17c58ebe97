"""Toxicity: a linear-chain CRF tags toxic tokens; marginals give scores.

Labels are per document, so token labels are derived first: from a bounded
sample of labelled rows, words and word beginnings that occur in toxic far more than in clean
documents are chosen greedily.  Uses in equal sentences count once, and a
document that a chosen word explains counts half from then on; both keep
out words that only travel along in copies.  The support asked for is a
small count, whatever the sample's size; rare words are left to the CRF's
penalty.
In toxic documents the chosen ones are labelled toxic, all else is clean.
The CRF of :mod:`.crf` is fitted on the sample's sentences and tags every
whole text.  A document's score is a logistic function, fitted on the
sample, of the highest probability over its sentences that one holds a
toxic token (1 - P(all clean)) and of the expected number of toxic tokens
(sum of marginals).  Tokens with a marginal of one half and more are
reported as offending offsets (code points, end exclusive).

Defined cases: a null or empty text, or one without a word, has no toxic
token and gets the score of that; copies score alike; without toxic
training rows every score is 0; labels
other than 0 and 1 and null labels are not learned from, a document with
several labels counts as toxic if one is; an empty table gives an empty
result; columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import materialise
from .bytestream import Chunk, CodeMap, Tally, chunks, mix, run_codes, running_code, word_bounds
from .columns import crc_mod, text_or_empty
from .crf import Batch, Weights, any_toxic, fit, marginals

SAMPLE = 8_000      # labelled documents per class that the fit may see, by hash order
VOCABULARY = 2_000  # words and beginnings to choose from
BEGINNINGS = (8, 7, 6, 5, 4)  # bytes of word beginnings that may be learned
DECAY = 0.5         # weight left to a toxic document per chosen word in it
LEAST = 3           # toxic documents that must use a word to be learned
SUPPORT = 2.0       # weight of the toxic documents a chosen word must explain
THRESHOLD = 0.3

# Tokens are runs of ASCII letters, digits and non-ASCII bytes.
_GAP = np.ones(256, dtype=bool)
_GAP[ord("0"):ord("9") + 1] = False
_GAP[ord("a"):ord("z") + 1] = False
_GAP[0x80:] = False
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[ord("."), ord("!"), ord("?"), 0x0A]] = 1


class Sentences:
    """Words of a chunk with their codes, texts and sentences."""

    def __init__(self, c: Chunk):
        self.start, self.end, self.text = word_bounds(c, _GAP)
        self.total = running_code(c)
        self.code = run_codes(self.total, self.start, self.end)
        stops = np.cumsum(_STOP[c.data]) if len(c.data) else np.zeros(0, np.int64)
        mark = stops[self.start] if len(self.start) else stops
        new = np.ones(len(self.start), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (self.text[1:] != self.text[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(self.start)))

    def beginnings(self):
        """(words longer than ``k`` bytes, code of their first ``k``), longest first."""
        for k in BEGINNINGS:
            at = np.flatnonzero(self.end - self.start > k)
            yield at, run_codes(self.total, self.start[at], self.start[at] + k) ^ np.uint64(k)

    def indexed(self, index: CodeMap) -> np.ndarray:
        """Vocabulary index of every word: its own, else that of its
        longest known beginning, else 0."""
        found = index.get(self.code)[0].astype(np.int64) if len(self.code) else np.zeros(0, np.int64)
        for at, code in self.beginnings():
            at, code = at[found[at] == 0], code[found[at] == 0]
            if len(at):
                found[at] = index.get(code)[0]
        return found


def sample_labels(labels: DataFrame, train: Column, size: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most ``size`` training rows per class."""
    known = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spot = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [known.where(F.col("toxic") == k).orderBy(spot, "doc_id").limit(size) for k in (0, 1)]
    return materialise(parts[0].unionByName(parts[1]))


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, code of the sentence) of the first use of every word
    and word beginning in every text."""
    s = Sentences(c)
    place = np.arange(len(s.code)) - np.repeat(s.first, s.size)
    each = mix(s.code + mix(place.astype(np.uint64)))
    sentence = np.repeat(mix(np.add.reduceat(each, s.first)) if len(s.first) else each, s.size)
    parts = [(np.arange(len(s.code)), s.code), *s.beginnings()]
    at, code = (np.concatenate(x) for x in zip(*parts))
    text = s.text[at]
    order = np.lexsort((at, code, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(code[order].view(np.int64)) != 0) | (np.diff(text[order]) != 0)
    once = order[new]
    return text[once], code[once], sentence[at[once]]


def _strong_features(sample: DataFrame) -> tuple:
    """Words and beginnings that occur in toxic sample documents far more
    than in clean ones: (codes, clean counts, document and code of every
    distinct use in toxic ones, clean and toxic documents)."""
    def count(batches):
        tallies = {0: Tally(), 1: Tally()}
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                text, code, _ = _features(c)
                of = toxic[text + c.first]
                for k, t in tallies.items():
                    full = t.add(code[of == k])
                    if full is not None:
                        yield rows(k, *full)
        for k, t in tallies.items():
            yield rows(k, *t.rest())

    def rows(k, code, n):
        return pa.record_batch({"code": pa.array(code.view(np.int64)), "toxic": pa.array(np.full(len(code), k, np.int32)),
                                "n": pa.array(n.astype(np.int64))})

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    counts = sample.select("toxic", "text").mapInArrow(count, "code bigint, toxic int, n bigint").groupBy("code").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    rate = F.col("t") / F.lit(max(1, n_toxic)) / ((F.col("c") + 1) / F.lit(n_clean + 1))
    top = counts.where((F.col("t") >= LEAST) & (rate >= 3)) \
        .orderBy(F.desc(F.col("t") * F.log(rate)), "code").limit(VOCABULARY).toArrow()
    strong = np.sort(top["code"].to_numpy().view(np.uint64))

    def uses(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                text, code, sentence = _features(c)
                at = np.flatnonzero(np.isin(code, strong))
                yield pa.record_batch({"doc": pa.array(ids[text[at] + c.first]), "code": pa.array(code[at].view(np.int64)),
                                       "sentence": pa.array(sentence[at].view(np.int64))})

    held = sample.where(F.col("toxic") == 1).select("doc_id", "text").mapInArrow(
        uses, "doc bigint, code bigint, sentence bigint") \
        .groupBy("code", "sentence").agg(F.min("doc").alias("doc")).toArrow()  # at most SAMPLE x VOCABULARY rows
    return (top["code"].to_numpy().view(np.uint64), top["c"].to_numpy(), held["doc"].to_numpy(),
            held["code"].to_numpy().view(np.uint64), n_clean, n_toxic)


def choose_words(codes, clean, doc, code, n_clean: int, n_toxic: int) -> np.ndarray:
    """Greedy cover of the toxic documents; True for the chosen codes."""
    chosen = np.zeros(len(codes), bool)
    if not len(codes):
        return chosen
    order = np.argsort(codes)
    of = order[np.searchsorted(codes[order], code)]
    _, doc = np.unique(doc, return_inverse=True)
    weight = np.ones(doc.max() + 1 if len(doc) else 0)
    while True:
        support = np.bincount(of, weights=weight[doc], minlength=len(codes))
        lift = support / max(1, n_toxic) / ((clean + 1) / (n_clean + 1))
        value = np.where(~chosen & (lift >= 5) & (support >= SUPPORT), support * np.log(np.maximum(lift, 1)), 0.0)
        best = int(np.argmax(value))
        if value[best] <= 0:
            return chosen
        chosen[best] = True
        weight[np.unique(doc[of == best])] *= DECAY


def _sentence_rows(sample: DataFrame, codes: np.ndarray) -> tuple[list, list, list]:
    """Distinct (tokens, from a toxic document) sentences with counts."""
    index = CodeMap(codes, np.arange(1, len(codes) + 1).astype(np.float64))

    def task(batches):
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                s = Sentences(c)
                token = s.indexed(index).astype(np.int32)
                at = pa.array(np.append(s.first, len(token)).astype(np.int32))
                yield pa.record_batch({"tokens": pa.ListArray.from_arrays(at, pa.array(token)),
                                       "toxic": pa.array(toxic[s.text[s.first] + c.first])})

    rows = sample.select("toxic", "text").mapInArrow(task, "tokens array<int>, toxic int") \
        .groupBy("tokens", "toxic").agg(F.count("*").alias("n")).toArrow()  # sentences of the bounded sample
    return rows["tokens"].to_pylist(), rows["toxic"].to_pylist(), rows["n"].to_pylist()


class Model:
    """Vocabulary codes with CRF weights and the weights of the document
    score; what tasks receive."""

    def __init__(self, codes: np.ndarray, weights: Weights, final=None):
        self.index = CodeMap(codes, np.arange(1, len(codes) + 1).astype(np.float64))
        self.weights, self.final = weights, final

    def score(self, peak: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if self.final is None:
            return np.zeros(len(peak))
        return 1 / (1 + np.exp(-np.clip(evidence(peak, expected) @ self.final, -50, 50)))

    def tag(self, c: Chunk):
        """(highest sentence probability, expected toxic tokens, spans) per
        text of a chunk.  Sentences without a vocabulary word differ by
        length alone, so one of each length is enough."""
        s = Sentences(c)
        score, expected, spans = np.zeros(c.n), np.zeros(c.n), [[] for _ in range(c.n)]
        if not len(s.code):
            return score, expected, spans
        token = s.indexed(self.index)
        hit = np.add.reduceat(token, s.first) > 0
        text = s.text[s.first]
        lengths, back = np.unique(s.size[~hit], return_inverse=True)
        if len(lengths):
            plain = Batch(np.zeros(lengths.sum(), np.int64), lengths)
            p = any_toxic(plain, self.weights, marginals(plain, self.weights)[1])
            np.maximum.at(score, text[~hit], p[back])
        if hit.any():
            inside = np.repeat(hit, s.size)
            b = Batch(token[inside], s.size[hit])
            toxic, z, _ = marginals(b, self.weights)
            np.maximum.at(score, text[hit], any_toxic(b, self.weights, z))
            expected += np.bincount(s.text[inside], weights=toxic, minlength=c.n)
            at = np.flatnonzero(inside)[toxic >= 0.5]
            if len(at):
                point = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                zero = point[c.offsets[s.text[at]]]
                for i, a, e in zip(s.text[at].tolist(), (point[s.start[at]] - zero).tolist(),
                                   (point[s.end[at]] - zero).tolist()):
                    spans[i].append(f"{a}:{e}")
        return score, expected, spans


def evidence(peak: np.ndarray, expected: np.ndarray) -> np.ndarray:
    p = np.clip(peak, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)), np.log1p(expected), np.minimum(expected, 4.0)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic function by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
    return w


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, size: int = SAMPLE) -> Model:
    """Fit on at most ``size`` labelled training rows per class."""
    picked = sample_labels(labels, train_rows, size)  # at most 2 * size rows: a proven bound
    sample = materialise(docs.join(F.broadcast(picked), "doc_id").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), text_or_empty(F.col("text")).alias("text")))
    codes, clean, doc, code, n_clean, n_toxic = _strong_features(sample)
    codes = codes[choose_words(codes, clean, doc, code, n_clean, n_toxic)]
    sentences, toxic, n = _sentence_rows(sample, codes)
    size_of = np.array([len(x) for x in sentences], np.int64)
    tokens = np.concatenate([np.asarray(x, np.int64) for x in sentences]) if sentences else np.zeros(0, np.int64)
    labels_of = ((tokens > 0) & np.repeat(np.asarray(toxic, np.int64) == 1, size_of)).astype(np.int64)
    if not labels_of.any():
        return Model(codes[:0], Weights(np.zeros((1, 3)), -50.0, np.zeros((2, 2))))
    model = Model(codes, fit(tokens, size_of, labels_of, np.asarray(n, np.float64), len(codes) + 1))
    seen = tagged(sample, model, {"toxic": F.col("toxic")}).select("toxic", "peak", "expected").toArrow()
    y = seen["toxic"].to_numpy().astype(np.float64)
    all_of = {r["toxic"]: r["n"] for r in labels.where(train_rows & F.col("toxic").isin(0, 1))
              .groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    share = np.where(y == 1, all_of.get(1, 0) / max(1, y.sum()), all_of.get(0, 0) / max(1, (1 - y).sum()))
    model.final = logistic(evidence(seen["peak"].to_numpy(), seen["expected"].to_numpy()), y, share / share.max())
    return model


def tagged(docs: DataFrame, model: Model, keep: dict, text: str = "text") -> DataFrame:
    """The columns ``keep`` (name -> Column) of every row with score, peak,
    expected and spans (start:end of toxic tokens, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = shared.value
        for batch in batches:
            parts = [model.tag(c) for c in chunks(batch.column("__text"))]
            peak, expected = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
            spans = [",".join(x) for p in parts for x in p[2]]
            kept = {k: batch.column(k) for k in batch.schema.names if k != "__text"}
            yield pa.record_batch({**kept, "score": pa.array(model.score(peak, expected)), "peak": pa.array(peak),
                                   "expected": pa.array(expected), "spans": pa.array(spans, pa.string())})

    asked = docs.select(*[c.alias(k) for k, c in keep.items()], text_or_empty(F.col(text)).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])
    return asked.mapInArrow(task, f"{schema}, score double, peak double, expected double, spans string")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of query ``op3`` and the offending spans."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held)
    return tagged(docs, model, {"doc_id": F.col("doc_id"), "held_out": held}) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

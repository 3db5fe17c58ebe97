"""Language mixtures of texts from n-gram likelihoods.

Training counts letter trigrams (hashed to ``BUCKETS``) per language over
all labelled training rows.  A word's likelihood under a language is the
product of its smoothed trigram shares.  For each document, expectation-
maximisation estimates the proportions of all languages from its words;
languages are then ranked by proportion, and among the leading 1, 2, ...
languages (each set fitted again) the one with the highest penalised
likelihood is the document's language set; sets grow as long as a language
has ``MIN_SHARE`` of the words.  The shares are those fitted to the chosen
set and sum to 1.  The prediction is the largest language of that set, its
score its proportion in the fit over all languages.

Defined cases: a null text or one without a letter is ``und`` with score
0; without training rows every text is ``und``; copies and repeated rows
are judged row by row; ties go to the language that sorts first; an empty
table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import materialise
from .bytestream import Chunk, chunks, mix, word_bounds
from .columns import crc_mod, text_or_empty

BUCKETS = 1 << 16
SMOOTH = 0.5
STEPS = 12          # EM rounds over all languages, then again per set
MIN_SHARE = 0.02    # a smaller language is not tried in a set
UND = "und"

# Bytes of letters: ASCII letters and all bytes of non-ASCII characters.
_GAP = np.ones(256, dtype=bool)
_GAP[ord("a"):ord("z") + 1] = False
_GAP[0x80:] = False


def _trigrams(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around every letter byte, first trigram of
    every word, text of every word); outside a word there are spaces."""
    start, end, row = word_bounds(c, _GAP)
    plain = np.where(_GAP[c.data], np.uint8(0x20), c.data).astype(np.uint64)
    before, after = np.full_like(plain, 0x20), np.full_like(plain, 0x20)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    before[start], after[end - 1] = 0x20, 0x20
    inside = ~_GAP[c.data]
    code = (before << np.uint64(16) | plain << np.uint64(8) | after)[inside]
    bucket = (mix(code + np.uint64(1)) >> np.uint64(48)).astype(np.int64)
    size = end - start
    return bucket, np.cumsum(size) - size, row


def count_languages(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of rows (lang, text); tasks sum their own first."""
    def task(batches):
        sums: dict = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                bucket, first, row = _trigrams(c)
                per_text = np.bincount(row, weights=np.diff(np.append(first, len(bucket))), minlength=c.n)
                names = langs[c.first:c.first + c.n]
                known = {x: i for i, x in enumerate(dict.fromkeys(names))}
                of = np.repeat([known[x] for x in names], per_text.astype(np.int64))
                got = np.bincount(of * BUCKETS + bucket, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for x, i in known.items():
                    sums[x] = sums.get(x, 0) + got[i]
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([x] * len(at), pa.string()),
                                   "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at].astype(np.int64))})

    return rows.mapInArrow(task, "lang string, bucket int, n bigint") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def mixtures(c: Chunk, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions in the fit over all languages, proportions in the fit of
    the chosen set, has words) of every text of a chunk.

    ``logp`` is (buckets, languages) of log shares.
    """
    n_lang = logp.shape[1]
    bucket, first, row = _trigrams(c)
    if len(row) == 0:
        return np.zeros((c.n, n_lang)), np.zeros((c.n, n_lang)), np.zeros(c.n, bool)
    word = np.add.reduceat(logp[bucket], first, axis=0)
    peak = word.max(axis=1, keepdims=True)
    like = np.exp(word - peak)
    doc_first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    docs = row[doc_first]                  # texts with words
    size = np.diff(np.append(doc_first, len(row)))
    of = np.repeat(np.arange(len(docs)), size)

    def fit(like, first, size, of, allowed):
        """EM from equal shares of the allowed languages; (shares, log likelihood)."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            part = like * share[of]
            whole = part.sum(axis=1)
            part /= np.maximum(whole, 1e-300)[:, None]
            share = np.add.reduceat(part, first, axis=0) / size[:, None]
        whole = (like * share[of]).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(whole, 1e-300)), first)

    share, _ = fit(like, doc_first, size, of, np.ones((len(docs), n_lang)))
    rank = np.argsort(-share, axis=1, kind="stable")
    fitted = np.zeros((len(docs), n_lang))
    fitted[np.arange(len(docs)), rank[:, 0]] = 1.0
    tried = (share >= MIN_SHARE).sum(axis=1)
    best = np.full(len(docs), -np.inf)
    for k in range(1, n_lang + 1):
        more = np.flatnonzero(tried >= max(k, 2))  # texts with a k-th candidate; one candidate needs no fit
        if not len(more):
            break
        words = np.isin(of, more)
        s2 = size[more]
        f2, o2 = np.cumsum(s2) - s2, np.repeat(np.arange(len(more)), s2)
        allowed = np.zeros((len(more), n_lang))
        np.put_along_axis(allowed, rank[more, :k], 1.0, axis=1)
        got, ll = fit(like[words], f2, s2, o2, allowed)
        gain = ll - (k - 1) * (np.log(s2) / 2 + 1)
        better = gain > best[more]
        best[more[better]] = gain[better]
        fitted[more[better]] = got[better]
    out_share, out_set, has = np.zeros((c.n, n_lang)), np.zeros((c.n, n_lang)), np.zeros(c.n, bool)
    out_share[docs], out_set[docs], has[docs] = share, fitted, True
    return out_share, out_set, has


def language_mixtures(docs: DataFrame, train: Column, keep: dict, text: str = "text",
                      lang: str = "lang") -> DataFrame:
    """The columns ``keep`` (name -> Column) of every row with lang_pred,
    score, langs (the set, largest first) and shares (of the set)."""
    rows = docs.where(train & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), text_or_empty(F.col(text)).alias("text"))
    counts = materialise(count_languages(rows)).toArrow()  # at most BUCKETS rows per language
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((BUCKETS, len(names)))
    index = {x: i for i, x in enumerate(names)}
    table[counts["bucket"].to_numpy(), [index[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    logp = np.log(table + SMOOTH) - np.log(table.sum(axis=0) + SMOOTH * BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast((names, logp))

    def task(batches):
        names, logp = shared.value
        for batch in batches:
            pred, score, langs, shares = [], [], [], []
            letter = batch.column("__letter").to_pylist()
            for c in chunks(batch.column("__text")):
                share, fitted, has = mixtures(c, logp) if names else (None, None, np.zeros(c.n, bool))
                for i in range(c.n):
                    order = [] if not (has[i] and letter[c.first + i]) else \
                        sorted(np.flatnonzero(fitted[i]), key=lambda j: (-fitted[i, j], j))
                    pred.append(names[order[0]] if order else UND)
                    score.append(min(1.0, float(share[i, order[0]])) if order else 0.0)
                    langs.append([names[j] for j in order])
                    shares.append([float(fitted[i, j]) for j in order])
            kept = {k: batch.column(k) for k in batch.schema.names if k not in ("__text", "__letter")}
            yield pa.record_batch({**kept, "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()),
                                   "langs": pa.array(langs, pa.list_(pa.string())),
                                   "shares": pa.array(shares, pa.list_(pa.float64()))})

    t = text_or_empty(F.col(text))
    asked = docs.select(*[c.alias(k) for k, c in keep.items()], t.alias("__text"), t.rlike(r"\p{L}").alias("__letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-2])
    return asked.mapInArrow(task, f"{schema}, lang_pred string, score double, langs array<string>, shares array<double>")


def language_report(docs: DataFrame) -> DataFrame:
    """Contract columns of query ``op10`` and the language set."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    return language_mixtures(docs, ~held, {"doc_id": F.col("doc_id"), "held_out": held})

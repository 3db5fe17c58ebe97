"""Trie scores, CRF, language mixtures."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodgrid.llm import bytestream as B
from moodgrid.llm import crf, langmix, lm, ppm, toxicity
from moodgrid.llm.columns import crc_mod


def test_words_and_codes():
    texts = ["A b\tc  dé", None, "", "x\ny", " lead and trail ", "dé"]
    c = next(B.chunks(pa.array(texts)))
    start, end, row = B.word_bounds(c)
    raw = c.data.tobytes()
    assert [(r, raw[a:b]) for a, b, r in zip(start, end, row)] == [
        (i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    codes = B.word_codes(c, start, end)
    assert codes[3] == codes[-1] and len(set(codes.tolist())) == len(codes) - 1
    assert [x.n for x in B.chunks(pa.array(["abc"] * 5), size=4)] == [1] * 5


def test_code_map_and_tally():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    m = B.CodeMap(keys, np.arange(len(keys)).astype(float))
    value, found = m.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[:len(keys)].all() and (value[:len(keys)] == np.arange(len(keys))).all()
    assert not B.CodeMap(keys[:0], np.zeros(0)).get(keys)[1].any()
    t, parts = B.Tally(limit=50), []
    for _ in range(30):
        parts.append(t.add(rng.integers(0, 100, 40, dtype=np.uint64)))
    parts.append(t.rest())
    assert sum(int(p[1].sum()) for p in parts if p is not None) == 1200


def test_model_file_is_small():
    for n in (700, 9_000, 40_000):  # slots follow the keys, not the next power of two
        assert B.CodeMap.size_for(n) <= n / 0.6
    t = B.Tally()
    for c in B.chunks(pa.array(["some text of many different words " * 3, "another text"] * 40)):
        t.add(ppm.grams(c, 5)[0])
    kept = ppm.Trie(*t.rest(), 5).arrays()
    counted = [v for k, v in kept.items() if not k.startswith(("codes", "ctx"))]
    assert counted and all(v.dtype.itemsize <= 2 for v in counted)


def brute_ppm(train, text, order):
    """log10 probability by the definition, with dictionaries."""
    full = Counter()
    for t in train:
        s = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            full[tuple(s[i - order:i + 1])] += 1
    levels = {order: full}
    for j in range(order - 1, -1, -1):
        levels[j] = Counter(g[1:] for g in levels[j + 1])
    s, total = [ppm.START] * order + list(text) + [ppm.END], 0.0
    for i in range(order, len(s)):
        barred, p = set(), 1.0
        for j in range(order, -1, -1):
            seen = {g[-1]: n for g, n in levels[j].items() if g[:-1] == tuple(s[i - j:i]) and g[-1] not in barred}
            if not seen:
                continue
            n = sum(seen.values())
            if s[i] in seen:
                p *= (2 * seen[s[i]] - 1) / (2 * n)
                break
            p *= len(seen) / (2 * n)
            barred |= set(seen)
        else:
            p *= 1 / max(1, ppm.SYMBOLS - len(levels[0]))
        total += math.log10(p)
    return total


def test_trie_matches_the_definition():
    train, order = [b"abracadabra", b"abba", b"", b"cab ab"], 3
    t = B.Tally()
    for c in B.chunks(pa.array([x.decode() for x in train])):
        t.add(ppm.grams(c, order)[0])
    trie = ppm.Trie(*t.rest(), order)
    for text in [b"abra", b"zzz", b"", b"cabbage", b"a" * 20]:
        c = next(B.chunks(pa.array([text.decode()])))
        assert trie.cost(ppm.grams(c, order)[0]).sum() == pytest.approx(brute_ppm(train, text, order))


def test_scores_both_ways_and_base(spark, odd_docs, no_docs):
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    keep = {"doc_id": F.col("doc_id"), "tag": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    a, b = (sorted(map(tuple, lm.score_texts(odd_docs, ~held, keep, max_broadcast=m).collect()), key=str) for m in (10**6, 0))
    assert len(a) == odd_docs.count() and len(b) == len(a)
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and x[4:6] == pytest.approx(y[4:6]) and x[6] == y[6]
    rows = odd_docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            counts.update((r[1] or "").encode().lower().split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    got = {(x[0], x[1]): x for x in a}
    for r in rows:
        w = (r[1] or "").encode().lower().split() + [None]
        x = got[r[0], zlib.crc32((r[1] or "").encode())]
        assert x[2:4] == (len(w), sum(counts[t] > 0 for t in w)) and x[6] == total
        assert x[4] == pytest.approx(sum(math.log10((counts[t] + .5) / (total + .5 * (distinct + 1))) for t in w))
    assert lm.lm_report(no_docs).count() == 0
    untrained = lm.score_texts(odd_docs, F.lit(False), {"doc_id": F.col("doc_id")}).collect()
    assert len(untrained) == odd_docs.count() and all(math.isfinite(r["score"]) for r in untrained)


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    w = crf.Weights(np.vstack([np.zeros(3), rng.normal(size=(3, 3))]), -0.4, np.array([[0, -.7], [.3, .9]]))
    seqs = [[1, 0, 2, 3], [0], [3, 3], [2, 1, 0]]
    b = crf.Batch(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    p, z, _ = crf.marginals(b, w)
    any_ = crf.any_toxic(b, w, z)
    at = 0
    for k, s in enumerate(seqs):
        total, on, clean = 0.0, np.zeros(len(s)), 0.0
        for y in itertools.product((0, 1), repeat=len(s)):
            e = sum(y[i] * (w.token[s[i], 0] + w.token[s[i - 1] if i else 0, 1]
                            + w.token[s[i + 1] if i + 1 < len(s) else 0, 2] + w.bias) for i in range(len(s)))
            e = math.exp(e + sum(w.move[x, v] for x, v in zip(y, y[1:])))
            total, on, clean = total + e, on + e * np.array(y), clean + e * (not any(y))
        assert p[at:at + len(s)] == pytest.approx(on / total)
        assert z[k] == pytest.approx(math.log(total)) and any_[k] == pytest.approx(1 - clean / total)
        at += len(s)


def test_toxic_words_are_found(spark, odd_docs, no_docs):
    import random
    rng = random.Random(4)
    words = [f"wort{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(40), rng.choice(["horrid", "vile", "grimfoo" + str(i)]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, lab).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    hit = next(i for i in held if labels[i][1] and "horrid" in rows[i][1])
    a = rows[hit][1].index("horrid")
    assert f"{a}:{a + 6}" in got[hit]["spans"].split(",")
    odd = toxicity.toxicity_report(odd_docs, lab).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity_report(no_docs, lab).count() == 0
    assert {r["score"] for r in toxicity.toxicity_report(docs, lab.limit(0)).collect()} == {0.0}


def test_fixed_phrase_and_rare_words_are_learned(spark):
    import random
    rng = random.Random(9)
    words, rare = [f"wort{i}" for i in range(150)], [f"{a}{b}{c}x" for a in "bdfg" for b in "aeiou" for c in "zk"]
    rows, want = [], {}
    for i in range(1800):
        w = [rng.choice(words) for _ in range(25)]
        if i % 3 == 0:
            bad = "go kill yourself now" if i % 2 else rare[i // 6 % len(rare)]
            w.insert(rng.randrange(25), bad)
            want[i] = "kill" if i % 2 else bad
        rows.append((i, " ".join(w) + "."))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i in want)) for i, _ in rows], "doc_id bigint, toxic int")
    got = [r for r in toxicity.toxicity_report(docs, lab).collect() if r["held_out"]]
    for part in (0, 1):  # rare words, the phrase
        asked = [r for r in got if r["doc_id"] in want and r["doc_id"] % 2 == part]
        assert sum(r["predicted"] for r in asked) >= 0.85 * len(asked), part
    spans = [(rows[r["doc_id"]][1].index("kill"), r["spans"].split(",")) for r in got if want.get(r["doc_id"]) == "kill"]
    assert sum(f"{a}:{a + 4}" in x for a, x in spans) >= 0.85 * len(spans)
    assert sum(r["predicted"] for r in got if r["doc_id"] not in want) <= 0.05 * len(got)


def test_languages(spark, odd_docs, no_docs):
    import random
    rng = random.Random(6)
    kinds = {"aa": ["kata", "kolo", "taka", "loko"], "bb": ["mine", "nime", "emin", "imen"]}
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(25)), lang))
    mixed = " ".join(kinds["aa"] * 10 + kinds["bb"] * 10)
    rows += [(100, mixed, None), (101, "123 !!", "aa"), (102, None, "bb"), (103, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langmix.language_report(docs).collect()}
    assert all(got[i]["lang_pred"] == r for i, _, r in rows[:60])
    assert set(got[100]["langs"]) == {"aa", "bb"} and got[100]["shares"][0] == pytest.approx(0.5, abs=0.1)
    assert [got[i]["lang_pred"] for i in (101, 102, 103)] == ["und"] * 3
    assert len(got[0]["langs"]) == 1 and got[0]["shares"] == [1.0]
    assert all(sum(r["shares"]) == pytest.approx(1.0) for r in got.values() if r["langs"])
    assert langmix.language_report(odd_docs).count() == odd_docs.count()
    assert langmix.language_report(no_docs).count() == 0
    nothing = langmix.language_mixtures(docs, F.lit(False), {"doc_id": F.col("doc_id")}).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_mixtures_of_many_languages_and_against_enumeration():
    """Eight languages with letters of their own: a text in equal parts of
    six has all six; shares of two against a grid of all proportions."""
    names = [chr(97 + 3 * i) * 2 + chr(98 + 3 * i) * 2 + chr(99 + 3 * i) for i in range(8)]
    logp = np.full((langmix.BUCKETS, 8), 0.5)
    for lang, word in enumerate(names):
        c = next(B.chunks(pa.array([" ".join([word, word[::-1], word[2:]] * 50)])))
        bucket, _, _ = langmix._trigrams(c)
        logp[:, lang] += np.bincount(bucket, minlength=langmix.BUCKETS)
    logp = np.log(logp) - np.log(logp.sum(axis=0))
    texts = [" ".join(names[:6] * 20), " ".join([names[1]] * 30 + [names[4]] * 10), names[7]]
    c = next(B.chunks(pa.array(texts)))
    _, fitted, has = langmix.mixtures(c, logp)
    assert has.all()
    assert fitted[0][:6] == pytest.approx([1 / 6] * 6, abs=0.01) and fitted[0][6:].sum() == 0
    assert fitted[2].tolist() == [0.0] * 7 + [1.0]
    bucket, first, row = langmix._trigrams(c)
    like = np.exp(np.add.reduceat(logp[bucket], first, axis=0)[row == 1][:, [1, 4]])
    grid = np.linspace(0, 1, 1001)
    best = grid[np.argmax([np.log(like @ [x, 1 - x] + 1e-300).sum() for x in grid])]
    assert fitted[1][1] == pytest.approx(best, abs=0.002) and fitted[1][4] == pytest.approx(1 - best, abs=0.002)

"""Filter audit, licence places, periodic runs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from moodgrid.llm import filteraudit as A
from moodgrid.llm import licenses as L
from moodgrid.llm import runs as R
from moodgrid.llm import queries  # noqa: F401  (registers)
from moodgrid.llm.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_license_places"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want)


# ------------------------------------------------------------------ op11

def brute_audit(docs, labels):
    """docs: (doc_id, text, source); every order applied to every row."""
    least, marks = {}, defaultdict(lambda: [False, False])
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            marks[i] = [marks[i][0] or q == 1, marks[i][1] or x == 1]
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and i > least[t]}
        rows.append((part or "", fails, *(marks[i] if i is not None and i in marks else (False, False))))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                mine = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(mine) - len(gone),
                                          sum(sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def got_audit(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def test_audit_by_applying_every_order(spark, odd_docs, no_docs):
    rng = random.Random(3)
    few, many = [f"w{i}" for i in range(9)], [f"v{i}" for i in range(400)]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.select("doc_id", "text", "source").collect()]
    for i in range(100, 190):
        t = " ".join(rng.choice(few if rng.random() < .4 else many) for _ in range(rng.choice([20, 60, 90])))
        t = t.upper() if rng.random() < .3 else t
        rows.append((i, t + (" a|b" if rng.random() < .3 else ""), rng.choice(["s", "u", None])))
    rows += [(200 + i, rows[-1 - i % 7][1], rng.choice(["s", "u"])) for i in range(40)]
    rows += [(None, rows[-1][1], "s"), (7, rows[-1][1], "u"), rows[-1], rows[-1]]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < .6] + [(9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows],
                                 "doc_id bigint, text string, source string, n_words double, part int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = brute_audit(rows, labels)
    assert got_audit(A.filter_audit(docs, lab)) == want
    assert got_audit(A.filter_audit(docs.repartition(5), lab, shard_bytes=700)) == want  # many shards
    assert A.filter_audit(no_docs, lab).count() == 0
    assert got_audit(A.filter_audit(docs, lab.limit(0))) == brute_audit(rows, [])


def test_term_matrix_is_encoded_globally(spark):
    texts = ["a b a", "b c", "", "a a a c d", None, "d"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string").repartition(3)
    shards = A.term_shards(docs, shard_bytes=4)
    terms = {r["word"]: r["term"] for r in A.dictionary(shards).collect()}
    assert sorted(terms) == ["a", "b", "c", "d"] and len(set(terms.values())) == 4
    seen = {}
    for r in A.term_matrix(shards).collect():
        for k, i in enumerate(r["doc_id"]):
            cut = slice(r["indptr"][k], r["indptr"][k + 1])
            seen[i] = dict(zip(r["indices"][cut], r["data"][cut]))
    assert seen == {i: {terms[w]: n for w, n in Counter((t or "").split()).items()} for i, t in enumerate(texts)}


# ------------------------------------------------------------------ op12

def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       (text or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for k, n in enumerate(L.PHRASES + L.NOTICES):
        ws = n.text.split()
        for i in range(len(words) - len(ws) + 1):
            same = [a == b for a, b in zip(words[i:], ws)]
            keys = all(all(same[j:j + len(key.split())]) for key in n.keys for j in range(len(ws))
                       if ws[j:j + len(key.split())] == key.split())
            if keys and sum(same) >= n.share * len(ws):
                out.append((i, k, n.label, len(ws), sum(same) / len(ws)))
    return len(words), sorted(out)


def test_license_places_by_definition(spark, odd_docs, no_docs):
    rng = random.Random(8)
    pool = ["the", "license", "mit", "under", "software", "Größe", "copy", "zeta"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    for i in range(100, 260):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(pool) for _ in range(rng.randint(0, 12))]
            notice = rng.choice(L.PHRASES + L.NOTICES).text.split()
            for _ in range(rng.randint(0, 4)):  # some words differ
                notice[rng.randrange(len(notice))] = rng.choice(pool)
            w += notice if rng.random() < .8 else notice[1:]
        rows.append((i, rng.choice([" ", ", ", "\n// "]).join(x.upper() if rng.random() < .3 else x for x in w)))
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id bigint, text string, places double, label string")
    got = Counter((r["doc_id"], r["label"], r["n_words"], tuple((p["start"], p["template"], p["label"], p["words"], p["share"])
                                                     for p in r["places"])) for r in L.license_places(docs.repartition(3)).collect())
    want = Counter((i, "x", n, tuple(found)) for i, t in rows for n, found in [brute_places(t)])
    assert got == want and any(k[3] for k in want)
    for r in L.license_report(docs).where("doc_id >= 100").collect():
        n, found = brute_places(dict(rows)[r["doc_id"]])
        base = [f for f in found if f[1] < len(L.PHRASES)]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({f[2] for f in base})) and r["labels"] == ",".join(sorted({f[2] for f in found}))
        assert r["score"] == max([f[4] for f in found], default=0.0)
    assert L.license_report(no_docs).count() == 0
    assert L.license_report(odd_docs).count() == odd_docs.count()


def test_rare_words_decide_which_places_are_probed():
    index = L.Index(L.PHRASES)
    df = np.full(len(index.codes), 5)
    starts, t, q = index.weigh(df).post
    assert len(t) == sum(min(len(w), 2) for w in index.words)
    common = index.words[2][0]  # "general" becomes frequent and is no longer looked up
    df[common] = 100
    starts, t, q = index.weigh(df).post
    assert (2, 0) not in set(zip(t.tolist(), q.tolist()))


# ------------------------------------------------------------------ op13

def brute_runs(w, least=R.LEAST):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(least, 2 * q) and not any(
                    all(w[x] == w[x + p] for x in range(a, a + size - p)) for p in range(1, q)):
                out.append((a, size, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_report(doc_id, text):
    w = brute_planted(doc_id, text)
    runs = brute_runs(w)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_text(rng):
    n, kind = rng.randint(0, 70), rng.randrange(5)
    if kind == 0:
        w = [rng.choice("ab") for _ in range(n)]
    elif kind == 1:
        w = [rng.choice("abc") for _ in range(5)] + [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * 8
    elif kind == 2:
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        w = y[:n]
    elif kind == 3:
        w = ["a"] * n
    else:
        w = [f"w{rng.randrange(60)}" for _ in range(n)]
        w = w + w if rng.random() < .5 else w
    if w and rng.random() < .3:
        w[rng.randrange(len(w))] = "ü"
    return rng.choice([" ", "\n", " \t"]).join(w)


def test_runs_by_definition():
    rng = random.Random(12)
    for _ in range(150):
        texts = [WORD.findall(periodic_text(rng)) for _ in range(rng.randint(1, 5))]
        number = {w: i for i, w in enumerate({w for t in texts for w in t})}
        codes = np.array([number[w] for t in texts for w in t], np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        for least in (R.LEAST, 2, 30):
            found = list(zip(*(x.tolist() for x in R.word_runs(codes, row, least))))
            for k, t in enumerate(texts):
                mine = [(a - first[k], b, c) for a, b, c in found if row[a] == k]
                assert mine == brute_runs(t, least)


def test_run_report_by_definition(spark, odd_docs, no_docs):
    rng = random.Random(13)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(i, periodic_text(rng)) for i in range(100, 300)]
    docs = spark.createDataFrame([(*r, 3, "z") for r in rows], "doc_id bigint, text string, runs int, `start` string")
    df = R.run_report(docs.repartition(4))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(brute_report(i, t) for i, t in rows)
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == want and any(k[1] for k in want)
    assert R.run_report(no_docs).count() == 0
    kept = R.periodic_runs(docs.where(F.col("doc_id") >= 100))
    assert kept.columns == ["doc_id", "start", *R.OUT]


def test_a_long_periodic_text():
    w = np.concatenate([np.arange(5000), np.tile(np.arange(5000, 5700), 40), np.zeros(20000, np.int64)])
    found = list(zip(*(x.tolist() for x in R.word_runs(w.astype(np.uint64), np.zeros(len(w), np.int64)))))
    assert found == [(5000, 28000, 700), (33000, 20000, 1)]

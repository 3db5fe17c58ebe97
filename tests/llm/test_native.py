"""Quality rules, secret ledger, packing and decontamination."""

import hashlib
import itertools
import re

import duckdb
import pytest

from moodgrid.llm import decontaminate as D
from moodgrid.llm import packing as P
from moodgrid.llm import quality as Q
from moodgrid.llm import secrets as S
from moodgrid.llm.queries import run_folder
from moodgrid.llm.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL

SPACE = "[\x20\x09-\x0d]+"


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_secret_ledger"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in df.select(*cols).orderBy("doc_id").collect()] == want


def repeated_words(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def test_quality_measures_on_odd_rows(odd_docs, no_docs):
    got = Q.apply_rules(odd_docs)
    assert got.count() == odd_docs.count()
    for r in got.collect():
        words = [w for w in re.split(SPACE, r["text"] or "") if w]
        m = r[Q.MEASURES]
        assert (m["n_words"], m["word_chars"]) == (len(words), sum(map(len, words)))
        assert m["n_repeat_words"] == repeated_words(words)
        if len(words) < 10:
            assert not r["__kept"]
    assert Q.keep_clean(odd_docs).columns == odd_docs.columns
    assert Q.keep_clean(no_docs).count() == 0


def test_clean_short_and_foreign_texts_stay(spark):
    own = [" ".join(f"{w}{i}" for i in range(60)) for w in ("sana", "ordo", "wort")]
    clean = [(1, "Yesterday Maria bought fresh bread, cheese, olives, grapes, wine at Lyon market.", "en"),
             (2, f"The start of it all\n{own[1]}\nThe start of it all", "en"),
             (3, own[0], "fi"), (4, own[1], None), (5, own[2] + " the and", "en")]
    bad = [(6, own[0], "en"), (7, own[1], "de-AT"), (8, own[2] + " the and" + "\nBuy now" * 4, "en"),
           (9, own[2] + " the and" + "\nBuy now" * 4, "fi")]
    docs = spark.createDataFrame(clean + bad, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in Q.keep_clean(docs).collect()} == {1, 2, 3, 4, 5}
    assert {r["doc_id"] for r in Q.keep_clean(docs.drop("lang")).collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert {r["doc_id"] for r in Q.quality_report(docs).where("kept").collect()} == {1, 2, 3, 4, 5}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {i for i, ok in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op2_quality_rules']})").fetchall() if ok} == {1, 2, 3, 4, 5}


def test_secret_spans_and_increments(spark, odd_docs, no_docs):
    texts = [(1, 'é token = "abcdefgh" x'), (2, "ff" * 12 + " AKIA" + "Q" * 16), (3, 'é token = "abcdefgh" x'),
             (4, "secret=token:abcdefgh"), (4, "secret=token:abcdefgh"), (5, None), (None, "a" * 30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    path = run_folder(spark, "test-ledger")
    rows = {r["doc_id"]: r for r in S.secret_report(docs, path).collect()}
    assert rows[1]["spans"] == "assign:2:19" and rows[3]["spans"] == rows[1]["spans"]
    assert rows[2]["spans"] == "hex:0:24,access:25:45"
    assert rows[4]["spans"] == ""  # the dropped match has used up its text
    assert rows[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[None]["n_hex"] == 1
    ledger = S.read_ledger(spark, path)
    assert ledger.count() == 5 == ledger.select("blob").distinct().count()
    # later versions: only unseen blobs and rule versions are scanned
    more = docs.union(spark.createDataFrame([(9, "new one AKIA" + "Z" * 16)], docs.schema))
    assert S.scan_unseen(more, ledger).count() == 1
    assert S.scan_unseen(more, ledger, version="2").count() == 6
    assert S.secret_report(more, path).count() == 8
    assert S.read_ledger(spark, path).count() == 6
    # two scans of the same blobs at the same time: increments that repeat them
    S.scan_unseen(more, S.empty_ledger(spark)).write.parquet(f"{path}/increment=again")
    assert S.read_ledger(spark, path).count() == 12
    assert S.join_back(more, S.read_ledger(spark, path)).count() == more.count()
    # a changed rule is a new version and finds what it now matches
    changed = S.RULES[:-1] + (S.RULES[-1]._replace(least=2),)
    assert S.rules_version(changed) != S.rules_version() and S.scan_unseen(more, ledger, rules=changed).count() == 6
    assert S.secret_report(odd_docs, run_folder(spark, "test-ledger")).count() == odd_docs.count()
    assert S.secret_report(no_docs, run_folder(spark, "test-ledger")).count() == 0


def test_boundaries_are_optimal():
    edges, counts, tokens = [1, 3, 4, 9, 20, 21], [5, 1, 7, 2, 3, 1], [5, 3, 28, 18, 60, 21]

    def padding(bounds):
        return sum(c * min(b for b in bounds if b >= e) - t for e, c, t in zip(edges, counts, tokens))
    for k in range(1, 7):
        best = min(padding(list(x) + [21]) for m in range(k) for x in itertools.combinations(edges[:-1], m))
        got = P.choose_boundaries(edges, counts, tokens, k)
        assert got[-1] == 21 and len(got) <= k and padding(got) == best


def test_batches_keep_the_budget(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "w " * (i % 37)) for i in range(2000)], "doc_id bigint, text string")
    rows = P.pack(docs, n_buckets=4, budget=200, shard_rows=64).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000))
    sizes = {}
    for r in rows:
        sizes.setdefault((r["bucket"], r["batch"]), []).append(r)
        assert r["n_tokens"] + r["padding"] == r["bucket_len"] >= r["n_tokens"]
    for batch in sizes.values():
        assert len(batch) == batch[0]["batch_rows"]
        assert len(batch) == 1 or len(batch) * batch[0]["bucket_len"] <= 200
    for b in {k[0] for k in sizes}:  # only the last batch of a bucket is not full
        ids = sorted(k[1] for k in sizes if k[0] == b)
        assert ids == list(range(len(ids)))
        assert len({len(sizes[b, i]) for i in ids[:-1]}) <= 1
    assert P.pack(odd_docs).count() == odd_docs.count()
    assert P.pack(no_docs).count() == 0


def test_leaks_against_brute_force(spark, odd_docs, no_docs):
    import random
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 20, 60])))) for i in range(8)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(80)]
        item = items[i % 8][1].split()
        if i % 3:
            part = list(item)
            if i % 3 == 2 and len(part) > 10:
                part[rng.randrange(len(part))] = "changed"
            words[30:30] = part
        docs.append((i, " ".join(words).upper() if i % 2 else ", ".join(words)))
    d = spark.createDataFrame(docs + [(70, None), (71, docs[1][1])], "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")

    def grams(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    import math
    from collections import Counter
    sets = {i: grams(t) for i, t in items if grams(t)}
    df, n = Counter(s for v in sets.values() for s in set(v)), len(sets)
    want = set()
    for i, t in docs + [(71, docs[1][1])]:
        g = grams(t)
        for item, v in sets.items():
            w = {s: 1 + math.log(n / df[s]) for s in set(v)}
            for a in range(max(1, len(g) - len(v) + 1)):
                p = set(g[a:a + len(v)])
                if sum(w[s] for s in p & set(v)) / (sum(w.values()) + len(p - set(v)) * (1 + math.log(n))) >= D.THRESHOLD:
                    want.add((i, item))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(d, b).collect()}
    assert got == want and want
    clean = D.without_leaks(d, b)
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in want} | {70}
    assert D.without_leaks(odd_docs, b).columns == odd_docs.columns
    assert D.without_leaks(odd_docs, b.limit(0)).count() == odd_docs.count()
    assert D.find_leaks(no_docs, b).count() == 0


def test_recall_of_borderline_windows(spark):
    """Windows of 20 to 90 words with a similarity from 0.8 up, found by the
    radius against brute force: at least 0.95 of them."""
    import random
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.choice([20, 40, 60, 90]))]) for i in range(40)]
    docs, want = [], set()
    for i in range(600):
        item, words = items[i % 40]
        part = list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            part[rng.randrange(len(part))] = "changed"
        docs.append((i, " ".join([rng.choice(vocab) for _ in range(30)] + part + [rng.choice(vocab) for _ in range(30)])))
        a, b = ({tuple(x[j:j + 5]) for j in range(len(x) - 4)} for x in (words, part))
        # shingles of one item only: all weigh the same
        if len(a & b) / len(a | b) >= D.THRESHOLD:
            want.add((i, item))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(d, b).collect()}
    recall = len(got & want) / len(want)
    print(f"recall {recall:.4f} of {len(want)}")
    assert recall >= 0.95

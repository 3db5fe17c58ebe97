"""Jaccard join, surrogates, WARC derivatives and the pipeline."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from moodgrid.llm import jaccard as J
from moodgrid.llm import pii as P
from moodgrid.llm import warc as W
from tests.conftest import SF_SMALL


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    held = {}
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in held.get(s, [])).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            held.setdefault(s, []).append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def copies(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 15, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    passage = [rng.choice(vocab) for _ in range(60)]
    docs += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.choice([2, 10, 100]))]) for _ in range(30)]
    return list(enumerate(docs + [None, "", "  "]))


@pytest.mark.parametrize("k,percent,long_list", [(3, 90, 16), (5, 80, 3), (2, 50, 3)])
def test_components(spark, monkeypatch, k, percent, long_list):
    monkeypatch.setattr(J, "LONG_LIST", long_list)
    monkeypatch.setattr(J, "BLOCK", 1500)
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in J.jaccard_components(df, k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_of_odd_rows(odd_docs, no_docs):
    got = J.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == 1 and by[2]["component_id"] == 2 and by[5]["component_id"] == 4
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == ids[2] == ids[3] == ids[4] == 1 and ids[5] == 0
    assert J.jaccard_components(no_docs).count() == 0 and J.one_of_each(no_docs).count() == 0


def test_one_row_of_each_component_when_keys_repeat(spark):
    rng = random.Random(8)
    a, b, *lone = [" ".join(f"{n}{rng.randrange(10**6)}" for _ in range(30)) for n in "abcdefg"]
    for x, y in ((a, b), (b, a)):  # whichever text of key 5 has the smaller hash
        rows = [(None, t) for t in lone] + [(None, lone[0]), (5, x), (7, x + " copy"), (5, x), (5, y), (3, y + " copy"),
                                            (None, y), (5, ""), (5, None), (None, "")]
        kept = J.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
        assert Counter(map(tuple, kept)) == Counter(
            [(None, t) for t in lone] + [(5, x), (3, y + " copy"), (5, ""), (5, None), (None, "")])


def test_surrogates_keep_kind_and_distinctness(spark, odd_docs, no_docs):
    people = ["Mr John Smith", "Mrs Anna Müller", "Frau Vera Braun", "Dr. Борис Иванов", "Mr Adam Smith"]
    texts = [f"Mail a{i}.b@host{i % 3}.example.com or +1 (40{i % 10}) 555-77{10 + i}, {people[i % 5]}, 10.0.{i}.7 and "
             f"4111 1111 1111 1111; order 1234567890123456, v1.2.3" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "nothing here")],
                                 "doc_id bigint, text string")
    a, b = (sorted(P.replace_personal_data(docs, max_broadcast=m).collect()) for m in (10**6, -1))
    assert a == b
    seen = {}
    for r in a[:40]:
        old, new = P.find_entities(texts[r["doc_id"]]), P.find_entities(r["text"])
        assert [e.kind for e in old] == [e.kind for e in new] == ["email", "phone", "name", "ip", "card"]
        assert "order 1234567890123456, v1.2.3" in r["text"]
        for x, y in zip(old, new):
            for p, q in zip(x.parts, y.parts):
                assert p[1] != q[1] and seen.setdefault(p[:2], q[1]) == q[1] and q[0] == p[0]
    assert len({(k[0], v) for k, v in seen.items()}) == len(seen)
    assert (a[40]["text"], a[41]["text"]) == (None, "nothing here")
    assert P.without_personal_data(odd_docs).columns == odd_docs.columns
    assert P.without_personal_data(odd_docs).count() == odd_docs.count()
    assert P.without_personal_data(no_docs).count() == 0


def test_names_agree_in_all_their_mentions():
    def new(text):
        return P.replace_entities(text, {})[0]

    def words(text):
        return new(text).replace(".", " ").split()
    a = words("Mr John Smith met Anna. John Smith said SMITH and J. Smith agree, John's wife too")
    given, last = a[1], a[2]
    assert (given, last) != ("John", "Smith") and a[5:8] == [given, last, "said"] and a[8] == last.upper()
    assert a[11] == last and a[10] != "J" and a[13] == given + "'s" and a[4] == "Anna"
    for title in ("Dr", "Mr", "Prof. Dr."):
        assert words(f"{title} John Smith")[-2:] == [given, last]
    assert words("Mr John Paul Smith")[1::2] == [given, last] and words("Mr John Paul Smith")[2] != "Paul"
    assert new("Ms Smith-Jones").split(" ")[1].split("-")[0] == last and "Jones" not in new("Ms Smith-Jones")
    assert words("Mr. J. Smith")[-1] == last and "J." not in new("Mr. J. Smith")
    for text in ("Mr O'Neil", "Frau Vera von der Leyen", "Herr Hans-Peter O’Neil. Later Hans-Peter", "Dr Anna K. Weber"):
        old = {w for w in text.replace("-", " ").split()[1:] if w[0].isupper() and w != "Later"}
        assert not old & set(new(text).replace("-", " ").split())
    assert "von der" in new("Frau Vera von der Leyen") and new("Jean met Luc") == "Jean met Luc"


def test_phones_of_many_shapes():
    phones = ["555 123 4567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 1234567", "5551234567", "(555) 123 4567",
              "+44 (0)20 7946 0958", "0044 20 7946 0958", "+14155552671", "15551234567", "+9 (999) 999-9999", "555-123-4567"]
    for phone in phones:
        old = P.find_entities(f"Call {phone}, now")
        assert [(e.kind, e.start, e.end) for e in old] == [("phone", 5, 5 + len(phone))]
        new = P.surrogate(P.KEY, "phone", phone)
        assert new != phone and [e.kind for e in P.find_entities(f"Call {new}, now")] == ["phone"]
        assert [c.isdigit() or c for c in new] == [c.isdigit() or c for c in phone]
    for other in ("1690000000", "$5551234567", "3.14159265358979", "12,555,123,456", "2020-01-02 10:30", "a5551234567", "0054994038693466"):
        assert P.find_entities(f"value {other} here") == []


def test_colliding_names_get_later_attempts(spark):
    names = [("given:latin:m", f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    parts = spark.createDataFrame(names, "kind string, value string")
    later = {r["value"]: r["attempt"] for r in P.later_attempts(parts).collect()}
    assert later  # the list of given names is shorter
    out = [P.surrogate(P.KEY, k, v, later.get(v, 0)) for k, v in names]
    assert len(set(out)) == len(out)


def test_given_names_match_the_gender_of_their_titles(spark):
    texts = ["Mrs Anna Smith and Mr John Smith", "Dr Anna Smith", "Mr John Brown", "Mr Peter Brown", "Dr Robin Wood",
             "Mr Kim Wood", "Mrs Kim Wood", "Herr Prof. Max Braun", "Dr Max Braun. Max agrees", "Frau Вера Браун"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bound in (10**6, -1):
        new = [r["text"] for r in P.replace_personal_data(docs, max_broadcast=bound).orderBy("doc_id").collect()]
        assert new[:10] == new[10:]
        first = [t.replace(".", "").split() for t in new]

        def like(word, script, gender):
            return any(word.startswith(x) for x in P.GIVEN[(script, gender)])
        anna, john = first[0][1], first[0][5]
        assert like(anna, "latin", "f") and like(john, "latin", "m") and first[1][1] == anna and first[2][1] == john
        assert like(first[3][1], "latin", "m") and first[3][1] != john and like(first[4][1], "latin", "n")
        assert first[5][1] == first[6][1] and like(first[5][1], "latin", "n")  # as many Mr as Mrs
        assert like(first[7][2], "latin", "m") and first[8][1] == first[7][2] == first[8][3]
        assert like(first[9][1], "cyrillic", "f")


def test_many_names_stay_distinct(spark):
    """Against a plain loop over all values: each keeps the first attempt
    that no value with a lower attempt, or an earlier one with the same, took."""
    names = [("given:latin:n", f"n{i}", "mf"[i % 2] if i % 3 else None) for i in range(2500)]
    parts = spark.createDataFrame(names + [("surname:latin", f"s{i}", None) for i in range(2500)],
                                  "kind string, value string, gender string")
    got = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in P.later_attempts(parts).collect()}
    todo, taken, want = [(k, v, g, 0) for k, v, g in parts.collect()], set(), {}
    while todo:
        again = []
        for k, v, g, a in sorted(todo, key=lambda x: (x[0], x[1])):
            new = P.surrogate(P.KEY, k, v, a, g)
            if (k, new) in taken or new.lower() == v:
                again.append((k, v, g, a + 1))
            else:
                taken.add((k, new))
                want[(k, v)] = (a, g)
        todo = again
    assert got == {x: ag for x, ag in want.items() if ag[0] or ag[1]} and len(taken) == 5000


def test_one_phone_has_one_surrogate():
    def digits(text):
        return "".join(c for c in P.replace_entities(f"Call {text}, now", {})[0] if c.isdigit())
    assert len({digits(x) for x in ("5551234567", "555-123-4567", "(555) 123 4567", "555 123 4567")}) == 1
    abroad = {digits(x) for x in ("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958")}
    assert len(abroad) == 1 and digits("0044 20 7946 0958") == "00" + abroad.pop()
    a, b = (P.replace_entities(f"Call {x}, now", {})[0] for x in ("+44 (0)20 7946 0958", "+44 20 7946 0958"))
    assert a.replace("(0)", "") == b and "(0)" in a


def test_plain_words_that_are_names_stay():
    def new(text):
        return P.replace_entities(text, {})[0]
    got = new("Mr Will Smith came. Will you go? I saw Will and Will Smith.")
    assert ". Will you go?" in got and "I saw Will" not in got and "and Will" not in got
    assert "Hope is" in new("Mrs Hope Brown left. Hope is all, I hope for Hope.") and "for Hope" in new("Mrs Hope Brown, I hope for Hope.")
    assert "Anna" not in new("Mrs Anna Brown left. Anna came back.")


def test_enciphering_is_a_bijection():
    for sizes in ([10, 10, 10], [7], [26, 10]):
        n = 1
        for s in sizes:
            n *= s
        every = [[v // (10 ** 0) % sizes[0]] if len(sizes) == 1 else None for v in range(n)]
        if len(sizes) > 1:
            import itertools
            every = [list(x) for x in itertools.product(*map(range, sizes))]
        assert len({tuple(P.encipher(b"k", "t", x, sizes)) for x in every}) == n


PAGE = ('<html lang="fr"><head><title>A &amp; b</title><script>var t="</p>";</script></head><body><!-- <p>no</p> -->'
        '<p>One <b>two</b></p><a href="/x?a=1&amp;b=2">link</a><p title="a>b">three</body>')


def test_warc_derivatives_round_trip(spark, no_docs):
    src = W.response(7, "http://h.example/a/", PAGE)
    conv, meta = W.derivatives(src)
    assert W.parse(b"".join(map(W.serialise, [src, conv, meta]))) == [src, conv, meta]
    assert conv["block"].decode() == "A & b\nOne two\nlink\nthree"
    fields = meta["block"].decode().split("\r\n")
    assert "title: A & b" in fields and "language: fr" in fields and "outlink: http://h.example/x?a=1&b=2" in fields
    named = dict(src["headers"])
    for r in (conv, meta):
        h = dict(r["headers"])
        assert h["WARC-Refers-To"] == named["WARC-Record-ID"]
        assert h["WARC-Source-Payload-Digest"] == named["WARC-Payload-Digest"] == W.digest(PAGE.encode())
        assert h["WARC-Block-Digest"] == W.digest(r["block"]) and int(h["Content-Length"]) == len(r["block"])
    pages = spark.createDataFrame([(1, "http://h.example/", PAGE, "x"), (1, "http://h.example/", PAGE, "x"), (2, None, None, "y"),
                                   (None, "::bad", "<a href='http://[x'>l</a><!-- open", "z")],
                                  "page_id bigint, url string, html string, block string")
    made = W.responses(pages)
    rows = W.derive(made).collect()
    assert len(rows) == 8 and {r["record_type"] for r in rows} == {"conversion", "metadata"}
    assert len({r["record_id"] for r in rows}) == 6
    assert W.derive(W.responses(pages.limit(0))).count() == 0
    # by the operator as by hand, for every page
    want = sorted((str(p["page_id"]), *_flat(r)) for p in pages.collect()
                  for r in W.derivatives(W.response(p["page_id"], p["url"], p["html"])))
    assert sorted((str(r["page_id"]), [tuple(h) for h in r["headers"]], r["block"]) for r in rows) == want


def _flat(record):
    return record["headers"], record["block"].decode()


def test_derivatives_keep_the_records_own_headers(spark):
    body = "<html lang='de'><title>Grüße</title>schöner Tag</html>".encode("iso-8859-1")
    block = b"HTTP/1.1 404 Not Found\r\ncontent-type: text/html; Charset=\"ISO-8859-1\"\r\nX-Served-By: a b\r\n\r\n" + body
    own = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2019-05-06T07:08:09Z"),
           ("WARC-Target-URI", "http://h.example/p"), ("WARC-IP-Address", "192.0.2.7"), ("WARC-Payload-Digest", "sha1:OWN")]
    bare = [("warc-type", "response"), ("Warc-Record-Id", "<urn:uuid:2>")]
    data = [(1, own, block, "x"), (1, own, block, "y"), (2, bare, b"plain \xff words", "x"), (3, bare, None, "x"),
            (4, [("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:3>")], block, "x"), (5, [("WARC-Type", "response")], block, "x"),
            (6, None, block, "x"), (7, bare, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=no-such\r\n\r\nok", "x")]
    records = spark.createDataFrame(data, "page_id int, headers array<struct<name:string,value:string>>, block binary, refers_to string")
    rows = W.derive(records).collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r["page_id"], []).append(r)
    assert {k: len(v) for k, v in by_page.items()} == {1: 4, 2: 2, 3: 2, 7: 2}
    conv = next(r for r in by_page[1] if r["record_type"] == "conversion")
    meta = next(r for r in by_page[1] if r["record_type"] == "metadata")
    assert conv["block"] == "Grüße\nschöner Tag" and conv["block_digest"] == W.digest(conv["block"].encode())
    for r in (conv, meta):
        assert (r["refers_to"], r["target_uri"], r["warc_date"], r["source_digest"]) == (
            "<urn:uuid:1>", "http://h.example/p", "2019-05-06T07:08:09Z", "sha1:OWN")
        named = {h["name"]: h["value"] for h in r["headers"]}
        assert named["WARC-Refers-To-Date"] == named["WARC-Date"] == "2019-05-06T07:08:09Z"
    lines = meta["block"].split("\r\n")
    assert "http-status: HTTP/1.1 404 Not Found" in lines and "http-header: X-Served-By: a b" in lines
    assert "warc-header: WARC-IP-Address: 192.0.2.7" in lines and "language: de" in lines
    assert f"conversion: {conv['record_id']}" in lines
    second = by_page[2][0]
    assert second["warc_date"] is None and second["target_uri"] is None
    assert second["source_digest"] == W.digest(b"plain \xff words")
    assert {r["block"] for r in by_page[2] + by_page[7] if r["record_type"] == "conversion"} == {"plain \ufffd words", "ok"}
    assert {r["block"] for r in by_page[3] if r["record_type"] == "conversion"} == {""}


def test_html_reader_is_linear():
    import time
    t = time.time()
    for bad in ('<a href="' * 20_000, "<!--" * 20_000, "<p '" * 20_000, "<script>" * 20_000):
        W.read_html(bad)
    assert time.time() - t < 20


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes = [docs.count()]
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == first.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    quality = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, first, SF_SMALL).collect()}
    comps = brute_components([(r["doc_id"], r["text"]) for r in first.collect() if r["doc_id"] in quality], 5, 80)
    assert {r["doc_id"] for r in rows} <= {c for _, c in comps.values()}

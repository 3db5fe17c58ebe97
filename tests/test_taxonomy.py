"""Dictionary files, taxonomy similarity and the rule lemmatiser against
small hand-made taxonomies and a plain graph search."""

import math
import random
from collections import deque

import pytest

from moodgrid.operators import etl as E
from moodgrid.operators import taxonomy as X

LINES = [
    "  1 a licence line",
    "00000001 03 n 01 entity 0 000 | that which is",
    "00000002 03 n 02 animal 0 Beast 0 001 @ 00000001 n 0000 | moves",
    "00000003 05 n 01 dog 0 002 @ 00000002 n 0000 ~ 00000005 n 0000 | barks | loudly",
    "00000004 05 n 01 cat 0 002 @ 00000002 n 0000 + 00000009 v 0101 | purrs",
    "00000005 05 n 02 puppy 0 dog 1 001 @i 00000003 n 0000 | young",
    "00000006 03 n 0a a 0 b 0 c 0 d 0 e 0 f 0 g 0 h 0 i 0 j 0 000 | ten words",
    "00000009 29 v 01 purr 0 000 01 + 02 00 | as a cat",
    "00000010 00 s 01 feline 0 001 & 00000011 a 0000 | like a cat",
    "", "broken line", "00000012 03 n 01",
]


@pytest.fixture(scope="module")
def synsets(spark):
    return X.parse_synsets(spark.createDataFrame([(v,) for v in LINES] + [(None,)], "value string")).cache()


def test_lines_with_words_and_pointers(synsets):
    got = {(r.pos, r.synset): (r.words, r.parents) for r in synsets.collect()}
    assert got[("n", 2)] == (["animal", "beast"], [1])
    assert got[("n", 3)] == (["dog"], [2])       # only hypernyms
    assert got[("n", 5)] == (["puppy", "dog"], [3])
    assert got[("n", 6)][0] == list("abcdefghij")  # hexadecimal word count
    assert got[("v", 9)] == (["purr"], []) and got[("a", 10)] == (["feline"], [])
    assert len(got) == 8


def test_measures_of_known_words(spark, synsets):
    words = spark.createDataFrame([("dog",), ("cat",), ("purr",), ("none",)], "word string")
    got = {(r.word_a, r.word_b, r.scheme): r.score for r in X.word_similarity(synsets, words, words).collect()}
    assert got[("dog", "dog", "path")] == 1.0 and got[("purr", "purr", "wup")] == 1.0
    # dog - animal - cat; animal has depth 3 below the virtual top, the deepest synset depth 5
    assert got[("dog", "cat", "path")] == round(1 / 3, 6) == got[("cat", "dog", "path")]
    assert got[("dog", "cat", "wup")] == 0.75
    assert got[("dog", "cat", "lch")] == round(math.log(2 * 5 / 3), 6)
    assert ("dog", "purr", "path") not in got and not any("none" in k for k in got)
    with pytest.raises(ValueError):
        X.word_similarity(synsets, words, words, ["lesk"])


def _search(graph, tops, start):
    """Shortest distances by a queue; the top is -1."""
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in graph[x] or ([X.TOP] if x in tops else []):
            if y not in seen:
                seen[y] = seen[x] + 1
                if y != X.TOP:
                    queue.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_random_taxonomy_against_search(spark, seed):
    rnd = random.Random(seed)
    n = 40
    graph = {i: sorted(set(rnd.choices(range(i), k=rnd.randint(1, 3)))) if i >= 3 else [] for i in range(n)}
    names = {i: [f"w{i}", f"w{rnd.randrange(n)}"] for i in range(n)}
    rows = [("n", i, names[i], graph[i]) for i in range(n)]
    rows += [rows[7]]  # a repeated line
    s = spark.createDataFrame(rows, "pos string, synset long, words array<string>, parents array<long>")
    up = {i: _search(graph, {0, 1, 2}, i) for i in range(n)}
    found = {}
    for r in X.ancestors(s).collect():
        found.setdefault(r.synset, {})[r.ancestor] = r.d
    assert found == up
    senses = {}
    for i, ws in names.items():
        for w in set(ws):
            senses.setdefault(w, []).append(i)
    depth = {i: up[i][X.TOP] + 1 for i in range(n)} | {X.TOP: 1}
    most = max(depth.values())
    want = {}
    for a in senses:
        for b in [f"w{i}" for i in range(5)]:
            common = [(up[x][c], up[y][c], c) for x in senses[a] for y in senses.get(b, []) for c in up[x].keys() & up[y].keys()]
            if common:
                length = min(p + q + 1 for p, q, _ in common)
                want[(a, b)] = (round(1 / length, 6), round(max(2 * depth[c] / (p + q + 2 * depth[c]) for p, q, c in common), 6),
                                round(math.log(2 * most / length), 6))
    words = spark.createDataFrame([(w,) for w in senses], "word string")
    targets = spark.createDataFrame([(f"w{i}",) for i in range(5)] * 2, "word string")
    got = {}
    for r in X.word_similarity(s, words, targets).collect():
        got.setdefault((r.word_a, r.word_b), {})[r.scheme] = r.score
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert [v[x] for x in X.SCHEMES] == pytest.approx(want[k], abs=2e-6)


def test_cycles_and_missing_parents_end_at_the_top(spark):
    s = spark.createDataFrame([("n", 1, ["a"], [2]), ("n", 2, ["b"], [1]), ("n", 3, ["c"], [99])],
                              "pos string, synset long, words array<string>, parents array<long>")
    got = {(r.synset, r.ancestor): r.d for r in X.ancestors(s).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, X.TOP): 2, (2, 2): 0, (2, 1): 1, (2, X.TOP): 2, (3, 3): 0, (3, X.TOP): 1}


def test_empty_tables(spark):
    s = spark.createDataFrame([], "pos string, synset long, words array<string>, parents array<long>")
    w = spark.createDataFrame([], "word string")
    assert X.word_similarity(s, w, w).count() == 0
    f = spark.createDataFrame([], "form string, pos string")
    assert X.rule_lemmas(f, spark.createDataFrame([], "word string, pos string")).count() == 0


def test_rules_exceptions_and_dictionary(spark):
    words = [("dog", "n"), ("church", "n"), ("bus", "n"), ("woman", "n"), ("baby", "n"), ("box", "n"), ("axis", "n"),
             ("ax", "n"), ("make", "v"), ("mak", "v"), ("carry", "v"), ("big", "a"), ("large", "a"), ("fast", "r"),
             ("", "n"), ("goose", "n")]
    forms = {("dogs", "n"): "dog", ("churches", "n"): "church", ("buses", "n"): "bus", ("women", "n"): "woman",
             ("babies", "n"): "baby", ("boxes", "n"): "box", ("axes", "n"): "ax", ("making", "v"): "mak",
             ("carries", "v"): "carry", ("larger", "a"): "large", ("largest", "a"): "large", ("faster", "r"): "faster",
             ("bus", "n"): "bus", ("dogs", "v"): "dogs", ("s", "n"): "s", ("", "n"): "", ("geese", "n"): "goose",
             ("Dogs", "n"): "Dogs", ("unknowns", "n"): "unknowns"}
    exc = [("axes", "n", "ax"), ("axes", "n", "axis"), ("geese", "n", "goose"), ("dogs", "v", "dogs"), ("unused", "n", "x")]
    f = spark.createDataFrame([*forms, *forms, (None, "n"), ("dogs", None)], "form string, pos string")
    got = X.rule_lemmas(f, spark.createDataFrame(words * 2, "word string, pos string"),
                        spark.createDataFrame(exc, "form string, pos string, base string")).collect()
    assert {(r.form, r.pos): r.lemma for r in got} == forms and len(got) == len(forms)


def test_files_of_a_distribution(spark, scratch, synsets):
    with open(f"{scratch}/data.noun", "w") as out:
        out.write("\n".join(x for x in LINES if " v " not in x[:14]))
    with open(f"{scratch}/noun.exc", "w") as out:
        out.write("geese goose\naxes ax axis\nlonely\n")
    assert X.read_synsets(spark, f"{scratch}/data.*").count() == 7
    exc = X.read_exceptions(spark, f"{scratch}/noun.exc", "n")
    assert sorted((r.form, r.base) for r in exc.collect()) == [("axes", "ax"), ("axes", "axis"), ("geese", "goose")]
    # the lemma table serves the plain dictionary scan too
    table = X.rule_lemmas(spark.createDataFrame([("entity", "n"), ("dogs", "n")], "form string, pos string"),
                          X.senses(synsets).select("word", "pos"))
    words = {r.word for r in E.read_wordnet_lemmas(spark, f"{scratch}/data.*", table).collect()}
    assert {"entity", "animal", "dog", "puppy"} <= words


def test_matrix_and_join_give_the_same_pairs(spark):
    """Word pairs of the task matrix are those of the join on ancestors,
    also with a word that shares no ancestor."""
    a = spark.createDataFrame([("x", "n", -1, 2), ("x", "n", 5, 1), ("y", "n", -1, 1), ("y", "v", -1, 1), ("z", "n", 9, 0)],
                              "word_a string, pos string, ancestor bigint, da int")
    b = spark.createDataFrame([("p", "n", -1, 3, 1), ("p", "n", 5, 1, 2), ("q", "n", -1, 1, 1), ("q", "n", 7, 0, 3)],
                              "word_b string, pos string, ancestor bigint, db int, depth int")
    rows = [sorted(map(tuple, f(a, b).select("word_a", "pos", "word_b", "l", "wup").collect()))
            for f in (X._best_paths, X._joined_paths)]
    assert rows[0] == rows[1]
    assert [r[:4] for r in rows[0]] == [("x", "n", "p", 3), ("x", "n", "q", 4), ("y", "n", "p", 5), ("y", "n", "q", 3)]

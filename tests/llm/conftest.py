import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text and
    extra columns with names the operators use themselves."""
    rng = random.Random(5)
    words = ["the", "and", "of", "de", "la", "alpha", "beta", "Gamma", "délta", "été", "und", "der"]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "lost key here"),
            (6, " ".join(rng.choice(words) for _ in range(4000))), (7, "x" * 3000), (8, "\n".join(["same line of text"] * 9))]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(12)]
    data = [(k, t, "en", "s", None if t is None else len(t), "u", 1.5, k) for k, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "node string, score double, `key` bigint")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

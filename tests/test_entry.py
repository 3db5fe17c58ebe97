"""Driver contract: entry smoke, registry consistency, and a fast oracle
comparison on the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from moodgrid.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["u3_afinn_range_counts", "t123_ingest_normalise", "t4_negation_scope", "f1_length_features",
        "f5_emoticons", "f7_pos_counts", "f9_nrc_lexicon_features", "s1_labelled_scan",
        "a4_score_histogram", "a7_label_f1_precision", "a13_threshold_sweep", "k1_topk_per_label",
        "m10_backfeed_selection", "s15_batch_assignment", "s18_related_words", "u10_similarity_diff",
        "a6_distance_histogram", "f11_word_tfidf", "t6_rule_lemmas", "s12_synset_files", "s19_taxonomy_wup",
        "u9_taxonomy_path", "m6_density_tree", "m7_min_cluster_size"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["lang", "label", "n_posts", "mean_score"]


def test_every_oracle_has_a_query():
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 60


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(dcols, cur.fetchall())

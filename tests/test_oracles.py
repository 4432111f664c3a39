"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tastegrid.plans import ORACLES, QUERIES
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
NO_SQL = {
    "knn_lsh", "mf_implicit", "mf_explicit", "mf_score_pairs", "ncf_mlp", "cf_latent", "rf_embeddings",
    "rf_classifier", "rf_tfidf", "kmeans", "pca2d", "rouge_l",
}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name)) == []


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["n"] > 0 and row["rmse"] >= row["mae"] > 0

"""Driver contract and the oracle diff on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from varloom.plans.oracle import ORACLE
from varloom.plans.queries import QUERIES

def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_workload_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, name):
    from tools.check_oracle import compare

    assert compare(spark, SF_SMALL, [name], verbose=True) == []


def test_search_flags_one_best_trial(spark):
    from varloom.plans import jobs, queries as q

    out = jobs.fit_and_select_frame(jobs.ml_frame(q._full(spark, SF_SMALL)), trials=3).collect()
    assert len(out) == 3 and sum(1 for r in out if r["is_best"]) == 1


def test_perceptron_fits_and_scores(spark):
    from pyspark.sql import functions as F

    from varloom.operators import fit
    from varloom.plans import jobs, queries as q

    rows = fit.with_features(jobs.ml_frame(q._full(spark, SF_SMALL)))
    out = fit.fit_and_score(rows.filter(F.col("split") == "train"), rows,
                            estimator=fit.perceptron(hidden=(8,), max_iter=5), by=["split"]).collect()
    assert sorted(r["split"] for r in out) == ["test", "train", "val"]
    assert all(r["mean_loss"] > 0 for r in out)


def test_perceptron_search_space():
    from varloom.operators import fit

    est = fit.perceptron()
    maps = fit.random_param_maps(est, trials=5)
    assert all(m[est.layers][0] == 4096 and m[est.layers][-1] == 2 for m in maps)
    assert {m[est.maxIter] for m in maps} <= {8, 10, 12}

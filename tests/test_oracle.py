"""Every registered query against its SQL at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check import DATA, compare, duck  # noqa: E402

from breezeframe.catalog import load_all  # noqa: E402

QUERIES, ORACLES = load_all()
SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        verdict, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
        assert verdict.startswith("ok"), verdict
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_only_random_or_trained_results_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "m11_fit_trees", "m12_rollout", "m13_importance", "t8_pacf", "e4_train_evaluate",
    }

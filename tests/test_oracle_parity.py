"""Every query with an oracle equals its DuckDB SQL on sf0.001 (exact after the shared snapping)."""
import pytest

import __spark_entry__ as E
from assetpulse.plans import catalog
from helpers import rows

from conftest import SF_SMALL

OWN = catalog.REGISTRY          # the training-data queries have their own tests
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in OWN}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


def test_every_query_has_oracle_or_is_documented():
    assert set(OWN) <= set(E.queries())
    no_oracle = set(OWN) - set(ORACLE)
    assert no_oracle <= {"gbt_scores", "feature_importance", "model_metrics", "feature_gain",
                         "model_info", "churn_model_metrics", "churn_model_scores", "cv_scores", "early_stopping"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert len(df.columns) == 59
    assert df.count() > 0

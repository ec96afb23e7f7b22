"""Models that read their rows many times get them from files, not from the joins that made them."""

import pytest

from strataframe.operators import estimate
from strataframe.plans import extras, more


class Stop(Exception):
    pass


@pytest.mark.parametrize("query", [extras.ml_01_offset_from_baseline, extras.ml_01_boosted_offset, extras.ml_02_linear_pipeline, more.ml_11_paired_populations, more.ml_09_forest])
def test_fits_start_from_written_rows(spark, monkeypatch, query):
    class Model:
        def fit(self, df):
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() > 0
            raise Stop

    monkeypatch.setattr(estimate, "offset_pipeline", lambda *a, **b: Model())
    with pytest.raises(Stop):
        query(spark, "/root/testdata/sf0.001")

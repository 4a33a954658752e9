"""Stand-in views reproduce the facts measured in FIXTURES.md."""
import pytest
from pyspark.sql import functions as F

from mercato import params as P
from mercato.operators import aggregates as A
from mercato.operators import filters as Fi
from mercato.plans import feature_store as FS
from mercato.sources.standin import Inputs

from conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("sf,rows,arts,kept", [(SF_SMALL, 5768, 200, 149), (SF_MID, 57593, 2000, 1558)])
def test_weekly_counts(spark, sf, rows, arts, kept):
    w = A.weekly_sales(Inputs(spark, sf).transactions())
    assert w.count() == rows
    assert w.select("article_id").distinct().count() == arts
    cs = Fi.cold_start_filter(w, P.STANDIN_TRAIN_END, P.STANDIN_COLD_START_WEEKS)
    assert cs.select("article_id").distinct().count() == kept
    assert Fi.min_history(w, 8).select("article_id").distinct().count() == arts


def test_chain_check_sf001(spark):
    f = FS.lag_features(A.weekly_sales(Inputs(spark, SF_MID).transactions()))
    r = f.agg(F.sum("lag_1").alias("s1"), F.sum("rolling_mean_4").alias("r4"),
              F.count("lag_4").alias("n4")).first()
    assert r.s1 == 57926 and r.r4 == pytest.approx(57919.1667, abs=1e-3) and r.n4 == 49593

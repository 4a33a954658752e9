"""Feature store: leakage and boundary tests."""
import datetime as dt

from pyspark.sql import functions as F

from mercato.functions import columns as C
from mercato.operators import filters as Fi
from mercato.plans import feature_store as FS

D = dt.date


def _weekly(spark, rows):
    return spark.createDataFrame(rows, "article_id string, week date, units_sold long")


ROWS = [("A", D(2020, 1, 6), 3), ("A", D(2020, 1, 13), 5), ("A", D(2020, 1, 27), 1), ("A", D(2020, 2, 3), 7),
        ("A", D(2020, 2, 10), 2), ("B", D(2020, 1, 6), 10), ("B", D(2020, 1, 13), 20)]


def test_first_row_has_no_history(spark):
    f = FS.lag_features(_weekly(spark, ROWS)).orderBy("article_id", "week").collect()
    firsts = [r for r in f if r.week == D(2020, 1, 6)]
    assert all(r.lag_1 is None and r.rolling_mean_4 is None for r in firsts)


def test_rolling_mean_is_per_article_previous_rows(spark):
    f = {(r.article_id, r.week): r for r in FS.lag_features(_weekly(spark, ROWS)).collect()}
    # A at 2020-02-10: previous four rows 3, 5, 1, 7 -> 4.0 ; B never leaks into A
    assert f[("A", D(2020, 2, 10))].rolling_mean_4 == 4.0
    assert f[("B", D(2020, 1, 13))].rolling_mean_4 == 10.0
    # lags are previous observed rows, not calendar weeks (the week of 01-20 is missing)
    assert f[("A", D(2020, 1, 27))].lag_1 == 5.0


def test_changing_one_article_does_not_change_another(spark):
    base = {(r.article_id, r.week): r for r in FS.lag_features(_weekly(spark, ROWS)).collect()}
    changed = [(a, w, u * 100 if a == "B" else u) for a, w, u in ROWS]
    other = {(r.article_id, r.week): r for r in FS.lag_features(_weekly(spark, changed)).collect()}
    for k, r in base.items():
        if k[0] == "A":
            assert r == other[k]


def test_future_weeks_do_not_change_past_features(spark):
    base = {(r.article_id, r.week): r for r in FS.lag_features(_weekly(spark, ROWS)).collect()}
    changed = [(a, w, 999 if w == D(2020, 2, 10) else u) for a, w, u in ROWS]
    other = {(r.article_id, r.week): r for r in FS.lag_features(_weekly(spark, changed)).collect()}
    for k, r in base.items():
        if k[1] < D(2020, 2, 10):
            assert r.lag_1 == other[k].lag_1 and r.rolling_mean_8 == other[k].rolling_mean_8


def test_split_is_right_closed(spark):
    df = spark.createDataFrame([(D(2020, 6, 22),), (D(2020, 6, 23),), (D(2020, 8, 22),), (D(2020, 8, 23),),
                                (D(2020, 9, 30),), (None,)], "t date")
    got = {r.t: r.split for r in Fi.with_split(df, "t", "2020-06-22", "2020-08-22", "2020-09-22").collect()}
    assert got == {D(2020, 6, 22): "train", D(2020, 6, 23): "val", D(2020, 8, 22): "val", D(2020, 8, 23): "test"}


def test_week_is_monday_and_iso_week(spark):
    df = spark.createDataFrame([(D(2020, 1, 5),), (D(2018, 12, 31),)], "d date")
    r = df.select(C.week_start("d").alias("w"), C.iso_week("d").alias("iw"),
                  C.day_of_week_monday0("d").alias("dow")).collect()
    assert r[0].w == D(2019, 12, 30) and r[0].dow == 6
    assert r[1].iw == 1 and r[1].dow == 0


def test_normalize_key_never_truncates(spark):
    df = spark.createDataFrame([("123",), ("12345678901",)], "k string")
    got = [r.k for r in df.select(C.normalize_key("k").alias("k")).collect()]
    assert got == ["0000000123", "12345678901"]


def test_cold_start_and_min_history(spark):
    w = _weekly(spark, ROWS)
    assert {r.article_id for r in Fi.min_history(w, 5).collect()} == {"A"}
    kept = Fi.cold_start_filter(w, "2020-01-13", 2).collect()
    assert {r.article_id for r in kept} == {"A", "B"} and len(kept) == len(ROWS)
    assert Fi.cold_start_filter(w, "2020-01-06", 2).count() == 0


def test_holdout_last_weeks(spark):
    h = Fi.with_holdout(_weekly(spark, ROWS), 2).where(F.col("split") == "test")
    assert {r.week for r in h.collect()} == {D(2020, 2, 3), D(2020, 2, 10)}

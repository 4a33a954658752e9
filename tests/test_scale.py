"""Orders, samples and percentiles on inputs that outgrow Spark's range
sample, with payload columns that the readers of a stored table prune
differently."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mercato.operators import evaluation as E
from mercato.operators import filters as Fi
from mercato.operators import topk as K
from mercato.operators.prefix import exact_percentiles, running_totals
from mercato.sources import io

N = 2_000_000


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(0, N, 1, 64).select(
        F.col("id").alias("k"), F.concat(F.lit("payload-"), F.col("id")).alias("text"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("stratum"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6).alias("score"))


def test_ranks_of_two_million_rows(many):
    cum = running_totals(many.withColumn("one", F.lit(1).cast("long")), ["score", "k"], ["one"], buckets=64)
    got = cum.agg(F.max("cum_one"), F.count_distinct("cum_one"), F.max(F.length("text")), F.max("total_one")).first()
    assert tuple(got) == (N, N, 15, N)
    low = cum.where("cum_one <= 3").orderBy("cum_one").select("score", "k").collect()
    assert low == many.orderBy("score", "k").limit(3).select("score", "k").collect()


def test_samples_have_their_size(many):
    got = K.sample_n(many, 1_000_000, ["k"])
    assert got.columns == many.columns
    assert got.agg(F.count("text"), F.count_distinct("k")).first() == (1_000_000, 1_000_000)
    sizes = {r["stratum"]: r["count"] for r in many.groupBy("stratum").count().collect()}
    kept = K.sample_stratified(many, "stratum", 0.1, ["k"])
    assert kept.columns == many.columns
    assert {r["stratum"]: r["count"] for r in kept.groupBy("stratum").count().collect()} == {
        s: -(-n // 10) for s, n in sizes.items()}


def test_small_samples_and_null_strata(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(1000)], "k long, s string")
    assert K.sample_n(df, 7, ["k"]).count() == 7 and K.sample_n(df, 5000, ["k"]).count() == 1000
    got = {r["s"]: r["count"] for r in K.sample_stratified(df, "s", 0.5, ["k"]).groupBy("s").count().collect()}
    assert got == {None: 125, "a": 375}


def test_samples_equal_a_plain_order(many):
    """Cells divided down to single draws (``few`` = 1) and not at all."""
    from mercato.functions.random import uniform
    df = many.where("k < 50000").withColumn("day", F.expr("date'2020-01-01' + cast(k % 7 as int)"))
    for few in (1, 10, 10 ** 9):
        u = uniform(["k", "day"], "sample:3")
        want = {r["k"] for r in df.orderBy(u, "k", "day").limit(777).collect()}
        assert {r["k"] for r in K.sample_n(df, 777, ["k", "day"], 3, few=few).collect()} == want
        w = W.partitionBy("stratum")
        want = (df.withColumn("_r", F.row_number().over(w.orderBy(uniform(["k"], "strat:3"), "k")))
                .withColumn("_n", F.count(F.lit(1)).over(w)).where("_r <= ceil(_n * 0.013)"))
        got = K.sample_stratified(df, "stratum", 0.013, ["k"], 3, few=few)
        assert {r["k"] for r in got.collect()} == {r["k"] for r in want.collect()}
    assert K.sample_n(df, 0, ["k"]).count() == 0 and K.sample_n(df.limit(0), 5, ["k"]).count() == 0
    assert K.sample_stratified(df, "stratum", 0.0, ["k"]).count() == 0


def test_a_sample_is_a_filter_of_the_scan(many, tmp_path):
    many.where("k < 5000").write.parquet(str(tmp_path / "t"))
    df = many.sparkSession.read.parquet(str(tmp_path / "t"))
    plan = K.sample_n(df, 100, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_next_rows_across_ranges(many):
    df = many.where("k < 20000").select("k", F.pmod(F.xxhash64("k"), F.lit(100)).alias("v"))
    for by, order in (([], [("k", False)]), (["v"], ["k"])):
        got = running_totals(df.withColumn("x", F.col("k") * 3), order, ["x"], by=by, buckets=16, following=True)
        w = W.partitionBy(*by).orderBy(F.col("k").desc() if not by else F.col("k"))
        want = df.withColumn("x", F.col("k") * 3).withColumn("next_x", F.lead("x").over(w))
        pick = ["k", "x", "next_x"]
        assert got.select(*pick).exceptAll(want.select(*pick)).isEmpty() and got.count() == want.count()


def test_roc_points_equal_a_plain_window(many):
    df = many.limit(400_000).withColumn("y", (F.pmod(F.xxhash64("k", F.lit(1)), F.lit(3)) == 0).cast("int"))
    got = E.roc_points(df, "y", "score")
    per = df.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = W.orderBy(F.col("score").desc())
    c = per.select("score", "pos", "neg", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                   F.lead("pos").over(w).alias("np"), F.lead("neg").over(w).alias("nn"), F.row_number().over(w).alias("r"))
    tot = per.agg(F.sum("pos"), F.sum("neg")).first()
    want = c.where("r = 1 or np is null or np <> pos or nn <> neg").select(
        F.col("score").alias("threshold"), (F.col("fp") / tot[1]).alias("fpr"), (F.col("tp") / tot[0]).alias("tpr"))
    a = got.agg(F.count("threshold"), F.sum("fpr"), F.sum("tpr")).first()
    b = want.agg(F.count("threshold"), F.sum("fpr"), F.sum("tpr")).first()
    # the scores are ranked without a join on their rank
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_bracketed_percentiles(spark, accuracy):
    """Groups of very different size and ties, brackets far smaller than the
    groups."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=20_000)] + [("ties", float(x)) for x in rng.integers(0, 4, 5_000)]
    rows += [("few", 1.0), ("few", 2.0), (None, 5.0), (None, 9.0)] + [("skew", float(x)) for x in rng.lognormal(2, 3, 3_000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(9)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in exact_percentiles(df, "x", probs, by=["g"], accuracy=accuracy).collect()}
    groups = {g for g, _ in rows}
    assert len(got) == len(groups) * len(probs)
    for g in groups:
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.quantile([x for h, x in rows if h == g], p)))
    whole = {r["prob"]: r["value"] for r in exact_percentiles(df, "x", probs, accuracy=accuracy).collect()}
    for p in probs:
        assert whole[p] == pytest.approx(float(np.quantile([x for _, x in rows], p)))


def test_both_top_lists_are_counted_on_the_whole_table(spark):
    """Colours of the garment that drops out still count for the colour list."""
    rows = [(f"g{g:02d}", f"c{(g + i) % 20:02d}") for g in range(15) for i in range(30 - g)]
    rows += [("rare", "only")] * 14 + [("rare2", "only")] * 3
    df = spark.createDataFrame(rows, "garment string, colour string")

    def top(col, n):
        counts = {}
        for r in rows:
            counts[r[col]] = counts.get(r[col], 0) + 1
        return set(sorted(counts, key=lambda v: (-counts[v], v))[:n])

    g, c = top(0, 12), top(1, 15)
    got = Fi.top_categories_filter(df, {"garment": 12, "colour": 15}).select("garment", "colour").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in g and r[1] in c)


def test_quoted_multi_line_articles_and_schema(spark, tmp_path):
    names = [f.name for f in io.ARTICLES_SCHEMA]
    row = [None] * len(names)
    row[names.index("article_id")] = "0108775015"
    row[names.index("detail_desc")] = 'Top with "quotes",\na second line'
    df = spark.createDataFrame([tuple(row)], io.ARTICLES_SCHEMA)
    io.write_csv(df, str(tmp_path / "a.csv"))
    back = io.read_articles(spark, str(tmp_path / "a.csv"), fmt="csv").collect()
    assert len(back) == 1 and back[0]["detail_desc"] == row[names.index("detail_desc")]
    tx = spark.createDataFrame([("2020-01-02", "c", "1", "0.5", "2")], "t_dat string, customer_id string, article_id string, "
                               "price string, sales_channel_id string")
    tx.write.parquet(str(tmp_path / "t.parquet"))
    assert dict(io.read_transactions(spark, str(tmp_path / "t.parquet")).dtypes)["price"] == "float"
    tx.drop("price").write.parquet(str(tmp_path / "u.parquet"))
    with pytest.raises(ValueError):
        io.read_transactions(spark, str(tmp_path / "u.parquet"))

"""Operator 3, mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight; a target stops at ``max_copies`` times
its source's size and the excess is shared again among the others. With
``r = target / size`` of a source, each of its documents is taken
``floor(r)`` times for certain. The rest of the target is a Pareto sample
with inclusion odds in proportion to a document's words: ``p = c * size``,
where the expected words, ``sum(p * size)``, are the rest. A document whose p
passes 1 gets a certain further copy; c is then solved again for the others,
until no p passes 1. Documents are ranked by random odds divided by inclusion
odds, ``(u / (1 - u)) / (p / (1 - p))``, and the sample is the run of
smallest ranks whose words fit the rest (its fixed size is a number of
words). One more document of the source, the one whose size comes nearest to
the gap left, closes it. Where that one misses the target by the smallest
spare document or more (a long document came early and did not fit), the run
goes on first: the documents behind it that are no larger than the gap are
run through in rank order, until the gap is below the smallest spare one.

The ranks of a source, scaled to (0, 1) by their middle, are cut into as many
buckets as a bucket has rows (the root of their number), so a source with a
third of all rows is summed by many tasks; only the bucket that holds the
cut is ordered row by row. Random numbers are
a function of doc_id and seed: reruns and retried tasks agree.

Cases: a null text has size 0; a document of size 0 is never taken; a null
source is a source of its own, last in order; rows that repeat a doc_id are
ranked by their size; a table without words has targets of 0; an empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, keyed, own_name, same_row, stored, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_COPIES, SEED = 1.5, 2, "mix-42"
_TWO52 = float(2 ** 52)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|" + seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO52)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Targets fill like water: ``target = least(max_copies * size, level * weight)``
    at the level where they sum to ``share`` of all words (or all are full).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # windows over one row per source
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(
        cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_copies)
    full_first = (W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()))
    every = W.partitionBy(F.lit(0))
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    # the level if exactly the sources before this one are full; the right one is the highest
    level = ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return per.select("source", "source_size", "n_docs",
                      F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    return taken_rows(docs.select("doc_id", "source", "text", F.lit(None).cast("long").alias("own")),
                      weights, share, max_copies, seed).drop("own")


def taken_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
               max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixture, with ``own`` of every row of ``docs``."""
    sized = stored(docs.select(
        "doc_id", "own", F.monotonically_increasing_id().alias("row"), F.col("source").cast("string").alias("source"),
        n_words(text_or_empty()).alias("size"),
        uniform(F.col("doc_id"), seed).alias("u")), "sized")
    targets = source_targets(sized, weights, share, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = (targets.withColumn("whole", F.floor(rate))
               .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
               .withColumn("n_buckets", F.ceil(F.sqrt(F.col("n_docs").cast("double"))).cast("long")))
    targets = stored(targets.withColumnRenamed("source", "_source"), "targets")

    rows = ranked(sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source"))
    run = run_that_fits(rows.where("not certain").withColumnsRenamed({"rest": "whole_rest", "sampled": "rest"}), "run")
    run = run.withColumnsRenamed({"rest": "sampled", "whole_rest": "rest"})
    kept = ["doc_id", "source", "size", "u", "place", "source_size", "target", "whole", "rest", "n_buckets", "extra", "own", "row"]
    taken = stored(run.select(*kept).unionByName(rows.where("certain").withColumn("extra", F.lit(1)).select(*kept)), "taken")
    closing = closing_rows(taken)
    while True:  # where one document does not close a gap, the run goes on behind what did not fit
        wide = stored(closing.where("left >= least").select(F.col("_source"), "gap"), "wide")
        if wide.isEmpty():
            break
        spare = (taken.where("extra = 0 and size > 0")
                 .join(wide, taken["source"].eqNullSafe(wide["_source"])).drop("_source").where("size <= gap"))
        more = run_that_fits(spare.withColumn("rest", F.col("gap")).drop("gap", "extra"), "more").where("extra = 1")
        more = stored(more.select(F.col("row").alias("_more")), "more")
        if more.isEmpty():
            break
        taken = stored(taken.join(more, taken["row"] == more["_more"], "left")
                       .withColumn("extra", F.greatest("extra", F.col("_more").isNotNull().cast("int"))).drop("_more"), "taken")
        closing = closing_rows(taken)
    nearest = stored(closing.where("closing is not null").select(F.col("closing").alias("_closing")), "nearest")
    done = taken.join(nearest, taken["row"] == nearest["_closing"], "left")
    copies = (F.col("whole") + F.col("extra") + F.col("_closing").isNotNull().cast("int"))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return done.select("doc_id", "own", "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``certain`` (the odds pass 1), ``sampled`` (the words of
    the rest without the certain documents) and ``place``, the rank scaled to
    (0, 1) in its order."""
    per = "_source", "_odds", "_least", "_sampled"
    known = None
    while True:  # each round finds at least one more certain document, or ends
        if known is None:
            now, sure = rows, F.lit(False)
        else:
            now, sure = rows.join(known, rows["source"].eqNullSafe(known["_source"])), F.col("size") >= F.col("_least")
        words = F.col("size").cast("double")
        sums = now.groupBy("source").agg(
            F.first("rest").alias("rest"), F.coalesce(F.sum(F.when(sure, words)), F.lit(0.0)).alias("sure"),
            F.coalesce(F.sum(F.when(~sure, words * words)), F.lit(0.0)).alias("squares"),
            F.max(F.when(~sure, words)).alias("most"))
        left = F.greatest(F.col("rest") - F.col("sure"), F.lit(0.0))
        odds = F.when(F.col("squares") > 0, left / F.col("squares")).otherwise(F.lit(0.0))
        # documents of 1 / odds words and more are certain
        least = F.when(odds > 0, 1 / odds).otherwise(F.lit(float("inf")))
        found = stored(sums.select(F.col("source").alias("_source"), odds.alias("_odds"), least.alias("_least"),
                                   left.alias("_sampled"), (F.coalesce("most", F.lit(0.0)) >= least).alias("_more")), "odds")
        going = found.where("_more").limit(1).count() > 0
        known = found.select(*per)
        if not going:
            break
    out = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source")
    p = F.least(F.col("_odds") * F.greatest("size", F.lit(1)), F.lit(1 - 1e-12))
    out = (out.withColumn("certain", (F.col("size") >= F.col("_least")) & (F.col("size") > 0)).withColumn("sampled", F.col("_sampled"))
           .withColumn("_logit", F.when(p > 0, F.log(p / (1 - p)))))
    middle = stored(out.where("not certain").groupBy("source").agg(F.avg("_logit").alias("_middle")).withColumnRenamed("source", "_source"), "middle")
    out = out.join(middle, out["source"].eqNullSafe(middle["_source"]), "left").drop("_source")
    rank = F.log(F.col("u") / (1 - F.col("u"))) - F.coalesce(F.col("_logit") - F.col("_middle"), F.lit(0.0))
    return out.withColumn("place", 1 / (1 + F.exp(-rank))).drop("_odds", "_least", "_sampled", "_logit", "_middle")


def run_that_fits(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``extra``: 1 for the run of smallest ranks of a source
    whose words fit its rest, 0 for the others."""
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("place") * F.col("n_buckets")), F.col("n_buckets") - 1))
    # words before and in each bucket; the rows of a bucket are in one range of ranks
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = stored(sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
                              F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"), "words"), f"{name}-buckets")
    placed = (rows.join(sums, rows["source"].eqNullSafe(sums["_source"]) & (rows["bucket"] == sums["_bucket"]))
              .drop("_source", "_bucket"))
    whole_in = placed.where(F.col("before") + F.col("words") <= F.col("rest")).withColumn("extra", F.lit(1))
    cut = placed.where((F.col("before") + F.col("words") > F.col("rest")) & (F.col("before") <= F.col("rest")))
    in_order = W.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_last(), "size")
    running = F.col("before") + F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    cut = cut.withColumn("extra", (running <= F.col("rest")).cast("int"))
    beyond = placed.where(F.col("before") > F.col("rest")).withColumn("extra", F.lit(0))
    return whole_in.unionByName(cut).unionByName(beyond)


def closing_rows(taken: DataFrame) -> DataFrame:
    """One row per source: the gap that its taken rows leave, the row nearest
    to it (null if none comes nearer than the gap), the words it still misses
    and the size of the smallest spare row."""
    gaps = (taken.groupBy("source").agg(F.first("rest").alias("rest"),
                                        F.sum(F.col("size") * F.col("extra")).alias("got"))
            .select(F.col("source").alias("_source"), (F.col("rest") - F.col("got")).alias("gap")))
    spare = taken.where("extra = 0 and size > 0")
    spare = spare.join(gaps, spare["source"].eqNullSafe(gaps["_source"])).withColumn("miss", F.abs(F.col("gap") - F.col("size")))
    nearer = F.when(F.col("miss") < F.col("gap"), F.struct("miss", "u", "doc_id", "size", "row"))
    of = spare.groupBy("source").agg(F.min(nearer).alias("n"), F.min("size").alias("least"), F.first("gap").alias("gap"))
    return stored(of.select(F.col("source").alias("_source"), "gap", "least", F.col("n.row").alias("closing"),
                            F.coalesce("n.miss", "gap").alias("left")), "closing")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    own, copy, columns = own_name(), own_name(), docs.columns
    docs = keyed(docs, own)
    copies = (taken_rows(docs.select("doc_id", "source", "text", F.col(own).alias("own")), **how).where("copies > 0")
              .select(F.col("doc_id").alias("_mix_id"), F.col("own").alias("_mix_own"),
                      F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("_each")))
    repeated = docs.join(copies, same_row(docs, copies, own, "_mix_id", "_mix_own"))
    return repeated.select(*[docs[c] for c in columns], F.explode(copies["_each"]).alias(copy)).drop(copy)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE_SQL: dict[str, str] = {}  # the mix goes on for as many rounds as it needs; tests compare with brute force

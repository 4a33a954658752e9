"""M1 / M2: preprocessing stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import (Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..session import stored

INFREQUENT = "infrequent"


def group_rare(train: DataFrame, df: DataFrame, cols: Sequence[str], min_count: int = 50,
               missing: str = P.MISSING_CATEGORY) -> DataFrame:
    """M2 (+ C14): categories seen fewer than ``min_count`` times in ``train``
    share one bucket; nulls become ``missing`` first. One pass counts the
    values of all columns and stores the frequent ones, a small table whose
    size the planner knows when it joins it back column by column."""
    def value(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(missing))

    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), value(c).alias("_value")) for c in cols])
    frequent = stored(train.select(F.explode(pairs).alias("_p")).groupBy("_p._col", "_p._value")
                      .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
                      .select("_col", "_value"), "frequent")
    out = df
    for c in cols:
        known = frequent.where(F.col("_col") == c).select(F.col("_value").alias(f"_known_{c}"))
        out = out.withColumn(c, value(c))
        out = (out.join(known, out[c] == known[f"_known_{c}"], "left")
                  .withColumn(c, F.coalesce(F.col(f"_known_{c}"), F.lit(INFREQUENT))).drop(f"_known_{c}"))
    return out


class _RareParams(HasInputCols):
    minCount = Param(Params._dummy(), "minCount", "rows that a category needs to stay", TypeConverters.toInt)
    missing = Param(Params._dummy(), "missing", "what stands for null", TypeConverters.toString)

    def value(self, col: str):
        return F.coalesce(F.col(col).cast("string"), F.lit(self.getOrDefault(self.missing)))


class RareCategories(Estimator, _RareParams, DefaultParamsReadable, DefaultParamsWritable):
    """M2 as a pipeline stage: categories are counted in the rows it is fitted
    on (the training part of a fold, say), in one pass over all columns. The
    frequent ones become part of the model, like the labels of the indexer
    that follows it."""

    def __init__(self, inputCols: Sequence[str] | None = None, minCount: int = 50, missing: str = P.MISSING_CATEGORY):
        super().__init__()
        self._set(minCount=minCount, missing=missing, **({"inputCols": list(inputCols)} if inputCols is not None else {}))

    def _fit(self, dataset: DataFrame) -> RareCategoriesModel:
        cols = self.getInputCols()
        pairs = F.array(*[F.struct(F.lit(c).alias("col"), self.value(c).alias("value")) for c in cols])
        rows = (dataset.select(F.explode(pairs).alias("_p")).groupBy("_p.col", "_p.value").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= self.getOrDefault(self.minCount)).collect())
        model = RareCategoriesModel()._set(frequent={c: sorted(r["value"] for r in rows if r["col"] == c) for c in cols})
        return self._copyValues(model)


class RareCategoriesModel(Model, _RareParams, DefaultParamsReadable, DefaultParamsWritable):
    """All but the frequent categories of each column become one bucket."""

    frequent = Param(Params._dummy(), "frequent", "the categories that stay, by column")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = self.getOrDefault(self.frequent)
        return dataset.withColumns({c: F.when(self.value(c).isin(known[c]), self.value(c)).otherwise(F.lit(INFREQUENT))
                                    for c in self.getInputCols()})


def column_stages(num: Sequence[str], cat: Sequence[str]) -> list:
    """What every vector is made from: numerics imputed by their median,
    categoricals (filled, see :class:`RareCategories`) indexed (unknown kept as
    an extra index)."""
    return [Imputer(strategy="median", inputCols=list(num), outputCols=[f"_imp_{c}" for c in num]),
            StringIndexer(inputCols=list(cat), outputCols=[f"_idx_{c}" for c in cat], handleInvalid="keep")]


def vector_stages(num: Sequence[str], cat: Sequence[str], scale: bool = True, one_hot: bool = True,
                  out: str = "features") -> list:
    """The vector of those columns: numerics (standardised), then categoricals
    one-hot (the unknown slot dropped, so unseen categories encode as zeros)
    or, for trees, as the nominal indexes they are."""
    stages = [VectorAssembler(inputCols=[f"_imp_{c}" for c in num], outputCol="_num_vec", handleInvalid="keep")]
    num_out = "_num_vec"
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_num_vec", outputCol="_num_scaled"))
        num_out = "_num_scaled"
    idx = [f"_idx_{c}" for c in cat]
    cat_out = idx
    if one_hot:
        ohe = [f"_ohe_{c}" for c in cat]
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep", dropLast=True))
        cat_out = ohe
    stages.append(VectorAssembler(inputCols=[num_out, *cat_out], outputCol=out, handleInvalid="keep"))
    return stages


def style_vectors(articles: DataFrame, cols: Sequence[str], out: str = "features"):
    """One-hot of the article attributes (all levels kept)."""
    idx = [f"_idx_{c}" for c in cols]
    ohe = [f"_ohe_{c}" for c in cols]
    pipe = Pipeline(stages=[
        StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="keep"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=False),
        VectorAssembler(inputCols=ohe, outputCol=out)])
    filled = articles.na.fill(P.MISSING_CATEGORY, subset=list(cols))
    model = pipe.fit(filled)
    return model.transform(filled), model

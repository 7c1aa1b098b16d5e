"""A learned ranker: one-hot categories and weighted title terms into logistic regression, scored out of fold."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows fitted per fold at most; the fit stays bounded, every row is scored.
MAX_FIT_ROWS = 200_000


def out_of_fold(rows: DataFrame, key: str, categories: list[str], text: str, label: str, folds: int = 3, features: int = 512) -> DataFrame:
    """(key, fold, label, p): the probability of each row from a model fitted on the other folds (at most ``MAX_FIT_ROWS`` of their rows, by hash)."""
    x = rows.select(key, F.col(label).cast("double").alias("label"), F.coalesce(text, F.lit("")).alias("__text"), *[F.coalesce(c, F.lit("-")).alias(c) for c in categories])
    x = x.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = []
    for k in range(folds):
        stages = []
        for c in categories:
            stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v")]
        stages += [RegexTokenizer(inputCol="__text", outputCol="__w", pattern="[^a-z0-9]+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features)]
        stages += [VectorAssembler(inputCols=[f"{c}_v" for c in categories] + ["__tf"], outputCol="features"), LogisticRegression(regParam=0.05, maxIter=20)]
        fit = x.where(F.col("fold") != k).orderBy(F.xxhash64(F.lit(1), key)).limit(MAX_FIT_ROWS)
        model = Pipeline(stages=stages).fit(fit)
        got = model.transform(x.where(F.col("fold") == k))
        out.append(got.select(key, "fold", "label", vector_to_array("probability")[1].alias("p")))
    return reduce(lambda a, b: a.unionByName(b), out)

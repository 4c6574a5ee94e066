"""Polarity classifier on text vectors (A1) - Spark ML, distributed fit and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import token_array

# Probability band of the positive class that reads as neutral.
NEUTRAL_BAND = (0.4, 0.6)


def hashed_features(docs: DataFrame, num_features: int = 1 << 12) -> DataFrame:
    """JVM-native text features: hashed token counts, L2-normalised -> ``(ord, features)``."""
    toks = docs.select("ord", token_array("text").alias("toks"))
    tf = HashingTF(inputCol="toks", outputCol="raw", numFeatures=num_features).transform(toks)
    return Normalizer(inputCol="raw", outputCol="features").transform(tf).select("ord", "features")


@dataclass
class Polarity:
    model: LogisticRegressionModel
    auc: float | None


def held_out(ord_: str = "ord", parts: int = 5) -> F.Column:
    """One row in ``parts``, by a hash of its key: never trained on, only scored."""
    return F.pmod(F.xxhash64(ord_, F.lit(17)), F.lit(parts)) == 0


def train(features: DataFrame, labels: DataFrame, label_col: str = "label",
          reg: float = 0.01, max_iter: int = 50) -> Polarity:
    """Fit a logistic regression (multinomial beyond two classes) on
    ``features(ord, features)`` joined with ``labels(ord, label)``.

    Held-out rows are left out of the fit; ``auc`` is theirs (two classes).
    """
    data = features.join(labels.select("ord", F.col(label_col).cast("double").alias("label")), "ord")
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=max_iter,
                            family="auto")
    model = lr.fit(data.where(~held_out()))
    auc = None
    test = data.where(held_out())
    if test.select("label").distinct().count() == 2 and model.numClasses == 2:
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(test))
    return Polarity(model, auc)


def score(pol: Polarity, features: DataFrame, band=NEUTRAL_BAND) -> DataFrame:
    """``(ord, prediction INT, p_positive DOUBLE, polarity STRING)``.

    Two classes (0 negative, 1 positive): neutral inside the band. Three
    classes (0 negative, 1 neutral, 2 positive): the likeliest one;
    ``p_positive`` is the probability of the last class.
    """
    out = pol.model.transform(features)
    probabilities = vector_to_array("probability")
    p = F.element_at(probabilities, -1)
    if pol.model.numClasses == 2:
        pol_col = (F.when(p >= band[1], F.lit("positive"))
                    .when(p <= band[0], F.lit("negative"))
                    .otherwise(F.lit("neutral")))
    elif pol.model.numClasses == 3:
        pol_col = F.element_at(F.array(*[F.lit(x) for x in ("negative", "neutral", "positive")]),
                               F.col("prediction").cast("int") + 1)
    else:
        raise ValueError(f"polarity has two or three classes, not {pol.model.numClasses}")
    return out.select("ord", F.col("prediction").cast("int").alias("prediction"),
                      p.alias("p_positive"), pol_col.alias("polarity"))


def confusion(scored: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Evaluation counts ``(label, prediction, held_out, n)``: read those of the held-out rows."""
    return scored.join(labels.select("ord", F.col(label_col).cast("int").alias("label")), "ord") \
                 .groupBy("label", "prediction", held_out().alias("held_out")).agg(F.count(F.lit(1)).alias("n"))

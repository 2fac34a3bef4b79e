"""A bag-of-words classifier: TF-IDF over words and pairs of words, logistic regression with balanced classes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with `weight`: all rows by (classes x rows of the class), so that classes count alike."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(counts.crossJoin(F.broadcast(whole))), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def fit(rows: DataFrame, text: str, label: str, features: int = 2500, iterations: int = 50) -> PipelineModel:
    """Fit on `text` and a numeric `label`."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}\p{N}_]+"), StopWordsRemover(inputCol="__w", outputCol="__s"), NGram(n=2, inputCol="__s", outputCol="__g"),
        CountVectorizer(inputCol="__s", outputCol="__tf1", vocabSize=features // 2), CountVectorizer(inputCol="__g", outputCol="__tf2", vocabSize=features - features // 2),
        VectorAssembler(inputCols=["__tf1", "__tf2"], outputCol="__tf"), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(class_weights(rows, label))

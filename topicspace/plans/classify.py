"""Text classification (C4, C5): labelled articles -> features -> a Spark ML
classifier; predictions; top-k accuracy on a held-out part.

The original trains a convolutional network on fixed-length word-vector
sequences in an external library. Here the job is re-aimed at Spark ML:
hashed TF-IDF features or document word-vector sums, and multinomial logistic
regression (or a multilayer perceptron)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.operators.evaluation import true_class_rank
from topicspace.operators.sampling import split_parts


def text_classifier(text: str = "content", label: str = "label", num_features: int = 1 << 12,
                    kind: str = "logistic", max_iter: int = 50, reg: float = 0.01,
                    layers: list[int] | None = None, seed: int = 0) -> Pipeline:
    """Tokenizer -> HashingTF -> IDF -> classifier."""
    stages = [Tokenizer(inputCol=text, outputCol="_words"),
              HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="features")]
    if kind == "logistic":
        stages.append(LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                                         regParam=reg, family="multinomial"))
    elif kind == "mlp":
        if not layers:
            raise ValueError("layers (input size, hidden sizes..., classes) are needed for 'mlp'")
        stages.append(MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                                     layers=layers, maxIter=max_iter, seed=seed))
    else:
        raise ValueError("kind must be 'logistic' or 'mlp'")
    return Pipeline(stages=stages)


def train_classifier(labelled: DataFrame, key: str = "article_id", label: str = "label",
                     weights=(0.8, 0.1, 0.1), pipeline: Pipeline | None = None,
                     model_path: str | None = None) -> tuple[PipelineModel, list[DataFrame]]:
    """Split by key hash (repeatable), fit on the first part, optionally save the
    model. Returns the model and the parts (train, validation, test)."""
    parts = split_parts(labelled.withColumn(label, F.col(label).cast("double")), key, weights)
    model = (pipeline or text_classifier(label=label)).fit(parts[0])
    if model_path:
        model.write().overwrite().save(model_path)
    return model, parts


def predict(model: PipelineModel, df: DataFrame, key: str = "article_id",
            label: str = "label") -> DataFrame:
    """``(key, label, prediction, scores)``; scores = class probabilities as an
    array of ``struct(label, score)``."""
    out = model.transform(df)
    probs = vector_to_array("probability")
    scores = F.transform(probs, lambda p, i: F.struct(i.cast("double").alias("label"),
                                                      p.alias("score")))
    return out.select(key, F.col(label).cast("double").alias(label), "prediction",
                      scores.alias("scores"))


def evaluate_topk(predictions: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """Top-k accuracy ``(k, accuracy, n)`` of scored predictions."""
    rank = true_class_rank("scores", label)
    return predictions.agg(F.lit(k).alias("k"),
                           F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias("accuracy"),
                           F.count(F.lit(1)).alias("n"))


def evaluate_saved(model_path: str, df: DataFrame, k: int = 5, key: str = "article_id",
                   label: str = "label") -> DataFrame:
    """C5: load a saved model and report top-k accuracy on ``df``."""
    return evaluate_topk(predict(PipelineModel.load(model_path), df, key, label), k, label)


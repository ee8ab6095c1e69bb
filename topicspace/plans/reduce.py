"""Dimension reduction of category vectors for inspection: principal
components (the data behind the original's 2-D plots)."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(vectors: DataFrame, key: str, vec: str = "vec", k: int = 1,
                         out: str = "pc") -> tuple[DataFrame, list[float]]:
    """Project vectors on their first ``k`` principal components:
    ``(key, out array<double>)`` and the explained-variance ratios.

    Spark ML PCA builds the d x d covariance with a distributed aggregate.
    Component signs are fixed so each component's largest entry is positive,
    which makes the projection repeatable."""
    df = vectors.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_f"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(df)
    comps = model.pc.toArray()  # d x k, small
    signs = []
    for j in range(k):
        col = comps[:, j]
        signs.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)
    proj = model.transform(df).select(key, vector_to_array("_p").alias("_a"))
    flipped = F.array(*[F.col("_a")[j] * F.lit(signs[j]) for j in range(k)])
    return proj.select(key, flipped.alias(out)), [float(x) for x in model.explainedVariance]

"""Linear / MLP probe on frozen features (J3, J4) with MLlib.

The reference trains a 256-unit hidden layer on frozen encoder features. MLlib's
``MultilayerPerceptronClassifier`` uses sigmoid hidden units (not ReLU) and
L-BFGS; a ``LogisticRegression`` is offered as the linear baseline. Training is
distributed by MLlib (treeAggregate of gradients), so features never go to the
driver. ``fit_linear_probe`` is the closed form of the least-squares baseline: one
aggregate of sufficient statistics, so its answer can be checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))


def fit_probe(df: DataFrame, label: str = "label", vec: str = "embedding", hidden: int = 256,
              n_classes: int = 3, kind: str = "mlp", seed: int = 42, max_iter: int = 100):
    d = features(df, vec).withColumn("_y", F.col(label).cast("double"))
    if kind == "mlp":
        dim = len(d.select(vec).first()[0])  # one row: the feature width
        est = MultilayerPerceptronClassifier(layers=[dim, hidden, n_classes], seed=seed, maxIter=max_iter,
                                             featuresCol="features", labelCol="_y")
    else:
        est = LogisticRegression(maxIter=max_iter, featuresCol="features", labelCol="_y")
    return est.fit(d)


def score_probe(model, df: DataFrame, label: str = "label", vec: str = "embedding",
                keys=("vec_id",)) -> DataFrame:
    """Export ``(keys…, reference_label, predicted_label)``."""
    out = model.transform(features(df, vec))
    return out.select(*keys, F.col(label).cast("int").alias("reference_label"),
                      F.col("prediction").cast("int").alias("predicted_label"))


@dataclass(frozen=True)
class LinearProbe:
    """Class scores of a vector: one weight per class and component, the last row for the constant 1."""

    classes: list[int]
    weights: list[list[float]]


def fit_linear_probe(df: DataFrame, label: str = "label", vec: str = "embedding", ridge: float = 1.0) -> LinearProbe:
    """Ridge regression on one-hot labels, solved from the Gram matrix of the features (with a constant). One
    pass sums the matrix and each class's feature sums per task (d (d + 1) + d K numbers, whatever the rows); the sums of
    the tasks are added by key, and only the totals reach the driver. Rows with a null label or component take no part."""
    rows = df.filter(F.col(label).isNotNull() & F.forall(vec, lambda x: x.isNotNull())).select(
        F.col(label).cast("long").alias("y"), F.transform(vec, lambda x: x.cast("double")).alias("x"))

    def sums(batches):
        gram, moment = None, {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = np.hstack([x, np.ones((len(x), 1))])
            gram = x.T @ x if gram is None else gram + x.T @ x
            y = np.array(batch.column(0))
            for c in np.unique(y):
                moment[int(c)] = moment.get(int(c), 0.0) + x[y == c].sum(axis=0)
        parts = [] if gram is None else [(-1, i, row) for i, row in enumerate(gram)] + [(1, c, m) for c, m in moment.items()]
        yield pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int64()),
            pa.array([p[2].tolist() for p in parts], pa.list_(pa.float64()))], names=["kind", "k", "v"])

    cells = rows.mapInArrow(sums, "kind int, k long, v array<double>").select("kind", "k", F.posexplode("v").alias("i", "v"))
    total = cells.groupBy("kind", "k", "i").agg(F.sum("v").alias("v")).toPandas()  # (d + 1) (d + 1 + K) rows
    gram = total[total.kind < 0].pivot(index="k", columns="i", values="v").to_numpy()
    moment = total[total.kind > 0].pivot(index="k", columns="i", values="v").sort_index()
    penalty = ridge * np.eye(len(gram))
    penalty[-1, -1] = 0.0
    return LinearProbe([int(c) for c in moment.index], np.linalg.solve(gram + penalty, moment.to_numpy().T).tolist())


def score_linear_probe(model: LinearProbe, df: DataFrame, label: str = "label", vec: str = "embedding",
                       keys=("vec_id",)) -> DataFrame:
    """``(keys…, reference_label, predicted_label)`` of the highest class score, the smallest class on a tie; null for
    a vector that is null or has a null component."""
    weights, classes = np.array(model.weights), np.array(model.classes)

    @F.pandas_udf("int")
    def predict(vectors: pd.Series) -> pd.Series:
        fine = vectors.notna()
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype="Int32")
        if fine.any():
            x = np.vstack(vectors[fine].to_list()).astype(np.float64)
            out[fine] = classes[np.argmax(np.hstack([x, np.ones((len(x), 1))]) @ weights, axis=1)]
        return out
    whole = F.when(F.forall(vec, lambda x: x.isNotNull()), F.col(vec))
    return df.select(*keys, F.col(label).cast("int").alias("reference_label"), predict(whole).alias("predicted_label"))

"""Numeric kernels on vector columns, array<double>."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.hashing import norm


def winsorised(df: DataFrame, value: str, quantile: float = 0.995) -> DataFrame:
    """Add `clipped`: values held within the quantile of the absolute values."""
    bound = df.agg(F.percentile(F.abs(F.col(value)), F.lit(quantile)).alias("_b"))
    return df.join(F.broadcast(bound)).withColumn("clipped", F.greatest(-F.col("_b"), F.least(F.col("_b"), F.col(value)))).drop("_b")


def mean_vector(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group and dim, mean: the mean of each dimension."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("mean"))


def direction(df: DataFrame, group: str, vector: str, base, target) -> DataFrame:
    """dim and x: the unit vector from the target's mean to the base's."""
    means = mean_vector(df.where(F.col(group).isin(base, target)), group, vector)
    gap = means.groupBy("dim").agg((F.sum(F.when(F.col(group) == base, F.col("mean"))) - F.sum(F.when(F.col(group) == target, F.col("mean")))).alias("gap"))
    size = gap.agg(F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("_n"))
    return gap.join(F.broadcast(size)).select("dim", (F.col("gap") / F.greatest("_n", F.lit(1e-12))).alias("x"))


def unit(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def layer_weight(layer: Column | str, centre: float, width: float) -> Column:
    """Gaussian weight of a layer around a centre."""
    x = (F.col(layer) if isinstance(layer, str) else layer) - centre
    return F.exp(-(x * x) / (2 * width * width))


def projected_out(vector: Column | str, along: Column | str) -> Column:
    """The vector without its part along a unit vector."""
    from dialoom.functions.hashing import dot

    v, u = (F.col(x) if isinstance(x, str) else x for x in (vector, along))
    return F.zip_with(v, u, lambda a, b: a - dot(v, u) * b)


def renormed(new: Column | str, old: Column | str) -> Column:
    """The new rows of a matrix (array of arrays), scaled to the Frobenius norm of the old."""
    n, o = (F.col(x) if isinstance(x, str) else x for x in (new, old))
    size = lambda m: F.sqrt(F.aggregate(F.transform(m, lambda r: norm(r) * norm(r)), F.lit(0.0), lambda s, x: s + x))
    scale = size(o) / F.greatest(size(n), F.lit(1e-12))
    return F.transform(n, lambda r: F.transform(r, lambda x: x * scale))


def null_space(df: DataFrame, group: str, vector: str, share: float = 0.01) -> DataFrame:
    """group, dim and row of the projector I - V V^T on what the group's vectors don't span. A group is one layer's samples;
    each task forms d x d Gram matrices of its rows, and only those are shuffled."""

    def squared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[Any, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby("g", dropna=False):
                x = np.stack(part["v"].to_numpy()).astype(float)
                grams[key] = grams[key] + x.T @ x if key in grams else x.T @ x
        if grams:
            yield pd.DataFrame({"g": list(grams), "gram": [x.ravel() for x in grams.values()]})

    def project(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = sum(x for frame in frames for x in frame["gram"])
        d = math.isqrt(len(gram))
        gram = gram.reshape(d, d)
        values, vectors = np.linalg.eigh(gram)
        kept = vectors[:, np.sqrt(np.maximum(values, 0)) > share * np.sqrt(max(values.max(), 0))]
        projector = np.eye(d) - kept @ kept.T
        yield pd.DataFrame({"g": [key[0]] * d, "dim": range(d), "row": projector.tolist()})

    kind = dict(df.dtypes)[group]
    return df.select(F.col(group).alias("g"), F.col(vector).alias("v")).mapInPandas(squared, f"g {kind}, gram array<double>").groupBy("g").applyInPandas(project, f"g {kind}, dim int, row array<double>").withColumnRenamed("g", group)

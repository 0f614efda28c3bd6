"""Column functions on numeric arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in ``body(v)``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bipolar(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def fit(v: Column, dim: int) -> Column:
    """Cut or zero-pad to `dim` entries."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    return F.slice(F.concat(doubles, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def normalise(v: Column, dim: int) -> Column:
    return let(
        fit(v, dim),
        lambda f: let(l2(f), lambda n: F.transform(f, lambda x: F.when(n > 0, x / n).otherwise(x))),
    )


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2(a) * l2(b) + F.lit(1e-8))


def role_pattern(dim: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when((i * 13 + 5) % 11 < 5, F.lit(-1)).otherwise(F.lit(1))
    )


def bind_aux(visual: Column, aux_code: Column, aux: Column, dim: int) -> Column:
    """Tie the code of a second feature vector to the visual code; no change when `aux` is absent."""
    mixed = bind(aux_code, role_pattern(dim))
    return F.when(aux.isNull() | (F.size(aux) == 0), visual).otherwise(bind(visual, mixed))


def gaussian_projection(feat_dim: int, dim: int, seed: int = 7) -> np.ndarray:
    """Seeded random projection with unit rows."""
    rows = np.random.default_rng(seed).standard_normal((dim, feat_dim))
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)


def pattern_projection(feat_dim: int, dim: int) -> np.ndarray:
    """Projection whose signs follow from the row and column number alone."""
    r, c = np.arange(dim)[:, None], np.arange(feat_dim)[None, :]
    return np.where((r * 31 + c * 17 + r * c) % 7 < 4, 1.0, -1.0) / feat_dim**0.5


def encoder(feat_dim: int, dim: int, projection=gaussian_projection):
    """Column function: sign (0 counts as +1) of the projection of the normalised vector.

    A code is thousands of entries wide, so the product is one matrix multiply per
    Arrow batch. The matrix is rebuilt from its rule in each task, not shipped.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        proj = projection(feat_dim, dim).T
        for batch in batches:
            x = np.zeros((len(batch), feat_dim))
            for i, v in enumerate(batch):
                if v is not None:
                    part = np.asarray(v, dtype=float)[:feat_dim]
                    x[i, : part.size] = part
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norms, out=x, where=norms > 0)
            # an exact zero may come out as rounding noise of either sign
            codes = np.where(x @ proj < -1e-12, -1, 1).astype(np.int32)
            yield pd.Series(list(codes))

    return encode

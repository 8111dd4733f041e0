"""Choosing attributes, and random features of a vector as functions of (seed, feature, component)."""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def uniform_value(seed: int, *keys: int) -> float:
    """A number in [0, 1) of a seed and some keys, the same on every machine."""
    text = "|".join(map(str, (seed, *keys)))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52


def normal_value(seed: int, *keys: int) -> float:
    """A standard normal number of a seed and some keys (Box-Muller)."""
    return math.sqrt(-2.0 * math.log(1.0 - uniform_value(seed, *keys, 0))) * math.cos(2.0 * math.pi * uniform_value(seed, *keys, 1))


def relu_weights(seed: int, latent: int, dims: int) -> list[list[float]]:
    return [[normal_value(seed, k, j) for j in range(dims)] for k in range(latent)]


def rbf_centres(seed: int, latent: int) -> list[float]:
    return [normal_value(seed, k) for k in range(latent)]


def relu_features(vector: str, weights: list[list[float]]) -> Column:
    """Per feature the product of its weights with the vector, 0 where that is negative; null if the vector is null or holds a null."""
    product = lambda w: F.aggregate(F.zip_with(vector, F.array(*[F.lit(x) for x in w]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.forall(vector, lambda x: x.isNotNull()), F.array(*[F.greatest(F.lit(0.0), product(w)) for w in weights]))


def rbf_features(vector: str, centres: list[float]) -> Column:
    """Per feature exp(-sum over the components of (component - centre)); every component counts alike, the class too if it is one of them."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.forall(vector, lambda x: x.isNotNull()), F.array(*[F.exp(-(total - F.size(vector) * F.lit(c))) for c in centres]))


def attribute_places(spec: str, n: int) -> list[int]:
    """Places (from 0) named by a list of numbers and ranges such as ``1,3-5``, which count from 1; what lies beyond n is an error."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        out += range(int(first) - 1, int(last or first))
    if wrong := [i + 1 for i in out if not 0 <= i < n]:
        raise ValueError(f"no attribute {wrong[0]}")
    return list(dict.fromkeys(out))


def select_attributes(df: DataFrame, inputs: str, outputs: str = "") -> DataFrame:
    """The columns that the two lists name, inputs first; a column named twice is there once."""
    places = dict.fromkeys(attribute_places(inputs, len(df.columns)) + attribute_places(outputs, len(df.columns)))
    return df.select([F.col(f"`{df.columns[i]}`") for i in places])


def numeric_attributes(df: DataFrame, klass: str | None = None) -> DataFrame:
    """Without the discrete columns; the class stays."""
    return df.select([f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, NumericType) or f.name == klass])

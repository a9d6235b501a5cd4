"""Vector geometry and energy as column expressions (they stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norm below which a cosine is 0, and the weights of the energy.
EPS = 1e-12
LAMBDA_SEM, LAMBDA_H, LAMBDA_R = 0.40, 0.20, 0.10


def as_vector(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; 0 where either is (nearly) zero."""
    a, b = as_vector(a), as_vector(b)
    return F.when((norm(a) < EPS) | (norm(b) < EPS), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_distance(a, b) -> Column:
    return 1.0 - cosine_similarity(a, b)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_vector(a), as_vector(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def energy(embedding, prototype, kappa, residual, lambda_sem: float = LAMBDA_SEM, lambda_h: float = LAMBDA_H, lambda_r: float = LAMBDA_R) -> Column:
    """Semantic distance, incoherence and residual, weighted."""
    return lambda_sem * cosine_distance(embedding, prototype) + lambda_h * (1.0 - kappa) + lambda_r * residual


def confidence_cap(confidence: Column, residual: Column) -> Column:
    """Confidence within [0, 1 - residual]; a NaN residual leaves it uncapped, a NaN confidence gives 0."""
    room = 1.0 - F.least(F.greatest(residual, F.lit(0.0)), F.lit(1.0))
    capped = F.when(F.isnan(residual), confidence).otherwise(F.least(confidence, room))
    return F.when(F.isnan(confidence), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), capped))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def mdl_bits(n_symbols: Column, residual: Column, dim: Column, n_obs: Column, gloss_chars: Column) -> Column:
    """Description length: vocabulary, residual and gloss bits."""
    vocabulary = F.greatest(n_symbols, F.lit(1)) * F.log2(F.greatest(n_symbols, F.lit(2)).cast("double"))
    return vocabulary + residual * dim * n_obs + gloss_chars * 8.0 / 32.0

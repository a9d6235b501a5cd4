"""Dynamics over symbols: bigram counts to a transition matrix, energy-tilted transition probabilities.

Matrices are long tables (src, dst, p) over the classes of a pack; k x k rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import energy


def bigrams(codes: DataFrame, entity: str, order: str, code: str = "code") -> DataFrame:
    """(src, dst, n): counts of neighbouring codes within an entity (an extension; counts may also be given)."""
    after = F.lead(code).over(Window.partitionBy(entity).orderBy(order))
    pairs = codes.where(F.col(code).isNotNull()).select(F.col(code).alias("src"), after.alias("dst"))
    return pairs.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def uniform(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(src, dst, p): every transition as likely as any other. classes: (class_id), one row for each; with ``by`` many alphabets at once."""
    by = by or []
    n = F.count("*").over(Window.partitionBy(*by, "src"))
    one, other = classes.select(*by, F.col("class_id").alias("src")), classes.select(*by, F.col("class_id").alias("dst"))
    pairs = one.join(other, by) if by else one.crossJoin(other)  # k x k by definition
    return pairs.withColumn("p", 1.0 / n)


def transition_matrix(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """Row-stochastic matrix of the counts (src, dst, n) among known classes; a class without counts has a uniform row."""
    base = uniform(classes).withColumnRenamed("p", "u").join(counts.groupBy("src", "dst").agg(F.sum(F.col("n").cast("double")).alias("n")), ["src", "dst"], "left")
    total = F.sum("n").over(Window.partitionBy("src"))
    return base.select("src", "dst", F.when(total > 0, F.coalesce("n", F.lit(0.0)) / total).otherwise(F.col("u")).alias("p"))


def tilted(base: DataFrame, symbols: DataFrame, residual, beta: float = 1.0, context: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """(src, class_id, p): each row of the base (src, dst, p) tilted by exp(-beta * energy) of the symbol it leads to.

    Without a context every symbol is measured against its own prototype. All weights 0: uniform. residual: a number, or a column of
    ``symbols``; with ``by`` many packs at once.
    """
    by = by or []
    own = F.col("proto_embedding")
    ctx = F.array(*map(F.lit, context)) if context else own
    r = residual if isinstance(residual, Column) else F.lit(float(residual))
    e = symbols.select(*by, F.col("class_id").alias("dst"), energy(ctx, own, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), r).alias("e"))
    rows = base.join(e, [*by, "dst"]).withColumn("w", F.col("p") * F.exp(-beta * F.col("e")))
    row = Window.partitionBy(*by, "src")
    total = F.sum("w").over(row)
    return rows.select(*by, "src", F.col("dst").alias("class_id"), F.when(total > 0, F.col("w") / total).otherwise(1.0 / F.count("*").over(row)).alias("p"))


class SubjectiveSymbolDynamics:
    """The dynamics of one pack for one subject: base matrix, updates from bigrams, tilted probabilities."""

    def __init__(self, pack, *, subject: str = "default", beta_s: float = 1.0):
        self.pack, self.subject, self.beta_s = pack, subject, float(beta_s)
        last = Window.partitionBy("class_id").orderBy(F.desc("pos"))
        self.symbols = pack.symbols.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        self.classes = self.symbols.select("class_id")
        self.transition = uniform(self.classes)

    def update_from_bigrams(self, counts) -> None:
        """Replace the matrix. counts: DataFrame (src, dst, n), or a dictionary {(src, dst): n}."""
        if isinstance(counts, dict):
            rows = [(int(a), int(b), float(n)) for (a, b), n in counts.items()]
            counts = self.pack.symbols.sparkSession.createDataFrame(rows, "src int, dst int, n double")
        self.transition = transition_matrix(self.classes, counts)

    def transition_probs(self, prev_class_id: int | None, context_embedding: list[float] | None = None) -> dict[int, float]:
        """{class: probability} after a class; an unknown class has a uniform base."""
        base = self.transition.where(F.col("src") == F.lit(prev_class_id))
        if prev_class_id is None or base.isEmpty():
            n = self.classes.count()
            base = self.classes.select(F.lit(-1).alias("src"), F.col("class_id").alias("dst"), F.lit(1.0 / max(n, 1)).alias("p"))
        out = tilted(base, self.symbols, self.pack.reconstruction_error, self.beta_s, context_embedding)
        got = {r["class_id"]: r["p"] for r in out.collect()}  # one row for each symbol
        assert not got or math.isclose(sum(got.values()), 1.0, abs_tol=1e-6)
        return got

"""How a new alphabet relates to the one before: survival of prototypes, alias matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_similarity

MATCH = 0.55


def similarities(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cosine of every old and every new prototype (of one alphabet: k x k rows).

    old, new: (pos, code, class_id, proto_embedding) and the columns of ``by``, on which they are joined.
    """
    side = lambda df, name: df.select(*(by or []), *(F.col(c).alias(f"{name}_{c}") for c in ("pos", "code", "class_id", "proto_embedding")))
    both = side(old, "old").join(side(new, "new"), by) if by else side(old, "old").crossJoin(side(new, "new"))  # alphabets of k symbols
    return both.withColumn("sim", cosine_similarity("old_proto_embedding", "new_proto_embedding")).drop("old_proto_embedding", "new_proto_embedding")


def survival(sims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(class_id, survival): the best cosine of a new prototype with any old one, at least 0."""
    return sims.groupBy(*(by or []), F.col("new_class_id").alias("class_id")).agg(F.greatest(F.max("sim"), F.lit(0.0)).alias("survival"))


def greedy_aliases(sims: list[tuple], threshold: float = MATCH) -> list[tuple[int, int]]:
    """(old code, new code) pairs from (old_pos, new_pos, old_code, new_code, new_class, sim): old symbols in order take the best unused new one above the threshold."""
    used, out = set(), {}
    by_old: dict[int, list[tuple]] = {}
    for row in sims:
        by_old.setdefault(row[0], []).append(row)
    for old in sorted(by_old):
        free = [r for r in by_old[old] if r[4] not in used and r[5] > threshold]
        if free:
            best = min(free, key=lambda r: (-r[5], r[1]))
            used.add(best[4])
            if best[2] != best[3]:
                out[best[2]] = best[3]
    return list(out.items())


def match_aliases(sims: DataFrame, threshold: float = MATCH, by: list[str] | None = None) -> DataFrame:
    """(pos, old_code, new_code) for each group of ``by``. The greedy choice is sequential by nature; each group is one k x k table in one task."""
    import pandas as pd

    by = by or []
    columns = ["old_pos", "new_pos", "old_code", "new_code", "new_class_id", "sim"]
    kinds = dict(sims.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = greedy_aliases(list(rows[columns].itertuples(index=False, name=None)), threshold)
        out = pd.DataFrame({"pos": range(len(got)), "old_code": [g[0] for g in got], "new_code": [g[1] for g in got]})
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    near = sims.where(F.col("sim") > threshold)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "pos int, old_code int, new_code int"])
    return near.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInPandas(run, schema)

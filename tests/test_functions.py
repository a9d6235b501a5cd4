import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical, text, vectors


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_geometry(spark):
    a, b = arr(1, 2, 3), arr(-2, 0.5, 4)
    x, y = np.array([1, 2, 3.0]), np.array([-2, 0.5, 4])
    cos = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert value(spark, vectors.cosine_similarity(a, b)) == pytest.approx(cos)
    assert value(spark, vectors.cosine_distance(a, b)) == pytest.approx(1 - cos)
    assert value(spark, vectors.euclidean_distance(a, b)) == pytest.approx(np.linalg.norm(x - y))
    assert value(spark, vectors.energy(a, b, F.lit(0.5), F.lit(0.2))) == pytest.approx(0.4 * (1 - cos) + 0.1 + 0.02)
    assert value(spark, vectors.cosine_similarity(arr(0, 0), arr(1, 1))) == 0.0
    assert value(spark, vectors.mdl_bits(F.lit(0), F.lit(0.5), F.lit(4), F.lit(10), F.lit(16))) == pytest.approx(1 + 20 + 4)


def test_confidence_cap(spark):
    def plain(c, r):
        return float(max(0.0, min(c, 1.0 - min(max(r, 0.0), 1.0))))

    for c in (-0.5, 0.0, 0.3, 0.9, 2.0, math.nan):
        for r in (-1.0, 0.0, 0.2, 1.0, 7.0, math.nan):
            assert value(spark, vectors.confidence_cap(F.lit(c), F.lit(r))) == pytest.approx(plain(c, r)), (c, r)
    assert [value(spark, vectors.is_finite(F.lit(x))) for x in (1.0, math.nan, math.inf, -math.inf)] == [True, False, False, False]


def test_text(spark):
    assert value(spark, text.tokens(F.lit("It's A 2nd-rate X1 été I"))) == ["it's", "nd", "rate", "x1"]
    assert value(spark, text.strip(F.lit(" \x1c\t a​  \n"))) == " \x1c\t a​  \n".strip()
    assert value(spark, text.normal_definition(F.lit(" \n"))) is None
    words = F.array(*map(F.lit, ["a1", "b1", "c1", "d1", "e1"]))
    assert value(spark, text.definition(words, F.lit("x"))) == "Symbol for a1, b1, c1, d1."
    none = F.array().cast("array<string>")
    assert value(spark, text.definition(none, F.lit("y" * 81))) == "Symbol attested by: " + "y" * 77 + "..."
    assert value(spark, text.definition(none, F.lit(None).cast("string"))) == ""
    assert value(spark, text.gloss_confidence(F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert value(spark, text.gloss_confidence(F.lit(9), F.lit(9), F.lit(8))) == 1.0


def test_ngrams(spark):
    rows = spark.createDataFrame([(0, "Hello there"), (1, "x"), (2, None), (3, ""), (4, "ß字" * 50)], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", text.hashed_ngrams("t").alias("v")).collect()}
    assert got[2] is None
    for i, t in ((0, "Hello there"), (1, "x"), (3, ""), (4, "ß字" * 50)):
        want, blob = np.zeros(32), ("^" + t.lower() + "$").ljust(3, "_")
        for k in range(len(blob) - 2):
            d = hashlib.sha256(blob[k : k + 3].encode()).digest()
            want[d[0] % 32] += 1 if d[4] % 2 == 0 else -1
        assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-300))
    cells = {k: round(v * math.sqrt(11)) for k, v in enumerate(got[0]) if v}
    assert cells == {1: 1, 6: -1, 7: -1, 19: -1, 21: 1, 22: -2, 25: -1, 26: -1}


def test_canonical():
    assert canonical.canonical_json({"b": [1e-5, None, "é"], "a": {"10": 1, "2": 2}}) == '{"a":{"10":1,"2":2},"b":[1e-05,null,"\\u00e9"]}'
    assert len(canonical.digest16({})) == 16


def test_scratch_deletes_what_was_written_inside(spark):
    import os

    from tessera.session import scratch, written

    kept = written(spark.range(3), "kept")
    with scratch(spark):
        inner = written(spark.range(4), "inner")
        assert inner.count() == 4 and os.path.isdir(inner._tessera_path)
    assert not os.path.exists(inner._tessera_path) and kept.count() == 3

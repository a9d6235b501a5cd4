import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "a", "The", "é", "字", "1", "23", "'s", "'ll", ".", "!!", "<|endoftext|>", "�", "\x1c", "\x85", "aaaa", "👩‍👩", "́", "\x00", "= ", " "]


def test_any_text(plain):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, "a" * 5000, "ab" * 3000, " " * 700, "\n" * 300, "字" * 3000]
    enc = bpe.Encoder(bpe.vocabulary_path())
    for _ in range(2):  # new pieces, then known ones
        ids, offsets = enc.encode(texts)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode_ordinary(t or ""), repr(t)
        assert (np.diff(offsets) == enc.lengths(texts)).all()


def test_forgetting(plain, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    enc = bpe.Encoder(bpe.vocabulary_path())
    for k in range(30):
        ids, _ = enc.encode([f"text number {k} of some", "words again"])
        assert ids.tolist() == plain.encode_ordinary(f"text number {k} of some") + plain.encode_ordinary("words again")


def test_table(spark, plain):
    long = "Der Sachverständige stellte 117 § fest. " * 5000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (4, "<|endoftext|>")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.token_ids(rows).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] == (3, plain.encode_ordinary(long)) and got[4][1] == plain.encode_ordinary("<|endoftext|>")
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(rows).collect()}[3] == len(got[2][1])
    assert bpe.token_ids(rows.where("doc_id > 9")).count() == 0

"""Text functions: tokens, stop words, definitions, hashed n-gram embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token pattern, stop words, limits.
TOKEN = r"[a-zA-Z][a-zA-Z0-9']+"
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "is", "are", "be", "this", "that", "with")
KEYWORDS, EXAMPLES = 8, 8
#: What Python counts as white space at the ends of a string.
_BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python strips."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}+", ""), f"{_BLANK}+$", "")


def normal_definition(text: Column) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_stop_word(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


def definition(keywords: Column, first_example: Column) -> Column:
    """The heuristic gloss: from the keywords, else from the first example, else empty."""
    snippet = F.when(F.char_length(first_example) > 80, F.concat(F.substring(first_example, 1, 77), F.lit("..."))).otherwise(first_example)
    head = F.concat(F.lit("Symbol for "), F.array_join(F.slice(keywords, 1, 4), ", "), F.lit("."))
    return F.when(F.size(keywords) > 0, head).when(first_example.isNotNull(), F.concat(F.lit("Symbol attested by: "), snippet)).otherwise(F.lit(""))


def gloss_confidence(n_observations: Column, n_texts: Column, n_keywords: Column) -> Column:
    return F.when(n_observations > 0, F.least(F.lit(1.0), 0.25 + 0.15 * n_texts + 0.05 * n_keywords)).otherwise(F.lit(0.0))


def _gram(gram: str, dim: int) -> tuple[int, float]:
    digest = hashlib.sha256(gram.encode("utf-8")).digest()
    return int.from_bytes(digest[:4], "little") % dim, 1.0 - 2.0 * (digest[4] & 1)


def ngram_vectors(texts: list[str], dim: int, n: int, known: dict) -> np.ndarray:
    """One row for each text. The grams of all texts are cut from one array of code points; each distinct one is looked up once."""
    framed = [("^" + t.lower() + "$").ljust(n, "_") for t in texts]
    sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    grams = np.lib.stride_tricks.sliding_window_view(points, n)
    keep = np.ones(len(grams), dtype=bool)  # not those across two texts
    ends = np.cumsum(sizes)[:-1]
    for k in range(1, n):
        keep[ends - k] = False
    owner = np.repeat(np.arange(len(framed)), sizes)[: len(grams)][keep]
    grams = grams[keep]
    if n <= 3:  # a code point has 21 bits
        keys = grams.astype(np.int64) @ (1 << 21 * np.arange(n, dtype=np.int64))
    else:
        keys = np.ascontiguousarray(grams).view(np.dtype((np.void, 4 * n))).ravel()
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    cells, signs = np.empty(len(first), dtype=np.int64), np.empty(len(first))
    for i, at in enumerate(first.tolist()):
        gram = "".join(map(chr, grams[at].tolist()))
        hit = known.get(gram)
        if hit is None:
            hit = known[gram] = _gram(gram, dim)
        cells[i], signs[i] = hit
    out = np.bincount(owner * dim + cells[place.ravel()], weights=signs[place.ravel()], minlength=len(framed) * dim).reshape(-1, dim)
    length = np.sqrt((out * out).sum(axis=1))
    return out / np.where(length > 0, length, 1.0)[:, None]


_KNOWN: dict[tuple[int, int], dict] = {}
_MOST_GRAMS = 1_000_000
#: Characters whose grams are worked on together.
_CHARS = 1_000_000


def hashed_ngrams(text: Column | str, dim: int = 32, n: int = 3) -> Column:
    """Signed hashed character n-grams, normalised: array<double> of ``dim`` elements.

    Grams are hashed once a worker and remembered (at most a million at a time); null gives null.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _KNOWN.setdefault((dim, n), {})
        for batch in batches:
            out, held, chars = [None] * len(batch), [], 0
            for at, t in enumerate(batch):
                if t is not None:
                    held.append((at, t))
                    chars += len(t)
                if held and (chars > _CHARS or at == len(batch) - 1):
                    if len(known) > _MOST_GRAMS:
                        known.clear()
                    for (k, _), row in zip(held, ngram_vectors([t for _, t in held], dim, n, known)):
                        out[k] = row
                    held, chars = [], 0
            yield pd.Series(out, dtype=object)

    return run(text)


def ensure_embedding(embedding: Column, text: Column, name: Column, dim: int = 32) -> Column:
    """The embedding; where it is missing or empty the hashed n-grams of the text; with neither an error naming the row."""
    blame = F.raise_error(F.concat(F.lit("observation "), F.coalesce(name, F.lit("null")), F.lit(" has neither embedding nor text"))).cast("array<double>")
    needed = F.when((F.size(embedding) > 0), F.lit(None).cast("string")).otherwise(text)  # only texts that are needed reach Python
    return F.when(F.size(embedding) > 0, embedding.cast("array<double>")).when(F.char_length(text) > 0, hashed_ngrams(needed, dim)).otherwise(blame)

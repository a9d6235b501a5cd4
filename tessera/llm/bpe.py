"""Byte-level BPE of a whole corpus with a public vocabulary.

Method. A batch of texts is cut at blanks into pieces no pre-token ever crosses, and only pieces a worker
has not met before are tokenised. Their pre-tokens are encoded together in merge rounds on flat numpy
arrays: the symbols of all words lie in one array; each round looks every adjacent pair up by binary search
in the sorted pair keys, takes the lowest-ranked pair of each word and merges all its occurrences, until no
word has a pair left. The ids of a text are then gathered from the pieces' ids by offset.

Pieces. ``text.split(" ")`` cuts before each blank. A pre-token holds a blank only as its first character or
inside a run of white space, so a cut is exact unless the blank stands between two other white-space
characters (or ends the text after one); such texts are cut by the pattern itself.

Defined results
---------------
* null and empty text: empty list. * text that looks like a special token: plain text.
* any length: whole texts, no prefix. * lone surrogates can't occur in Spark strings.
* repeated rows: repeated results. Empty table: empty result. Extra columns are not carried by ``token_ids``.

The memory of a worker is bounded: the table of known pieces is dropped when it holds ``MAX_PIECES``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.session import received, send_file

#: The split pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_PIECES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


class Merges:
    """Merge tables of a byte-level BPE, from a file of ``base64 rank`` lines, and batched encoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(rank.values()) + 1
        keys, ids = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ids.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ids = np.array(ids, dtype=np.int64)[order]
        whole = sorted(rank.items(), key=lambda x: x[1])
        self.whole = {token: r for token, r in whole}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_at, done_word = [], [], []
        place = np.arange(len(symbols))
        none = np.iinfo(np.int64).max
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            rank = np.where((self.pair_keys[at] == key) & (word[:-1] == word[1:]), self.pair_ids[at], none)
            # the lowest rank of each word
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], start)
            length = np.diff(np.r_[start, len(symbols)])
            open_word = best != none
            if not open_word.all():  # finished words leave the array
                keep = np.repeat(open_word, length)
                done_ids.append(symbols[~keep])
                done_at.append(place[~keep])
                done_word.append(word[~keep])
                symbols, place, word, rank = symbols[keep], place[keep], word[keep], np.r_[rank, none][keep][:-1] if keep.any() else rank[:0]
                best, length = best[open_word], length[open_word]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length)[:-1]) if len(rank) else np.zeros(0, dtype=np.int64)
            # of overlapping occurrences (a a a) those at even distance from the first of their row merge
            if len(hit) > 1 and (np.diff(hit) == 1).any():
                first = np.r_[True, np.diff(hit) != 1]
                group = np.flatnonzero(first)[np.cumsum(first) - 1]
                hit = hit[(np.arange(len(hit)) - group) % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = rank[hit]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, place, word = symbols[keep], place[keep], word[keep]
        ids = np.concatenate([*done_ids, symbols]) if done_ids else symbols
        at = np.concatenate([*done_at, place]) if done_at else place
        owner = np.concatenate([*done_word, word]) if done_word else word
        order = np.argsort(at, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))


class _Numbers(dict):
    """Numbers keys as they come; ``new`` has those met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Encoder:
    """Encodes batches of texts, remembering the pieces it has met."""

    SPLIT = regex.compile(PATTERN)
    #: A blank with white space on both sides, or at the end after white space: not safe to cut at.
    UNSAFE = regex.compile(r"\s \s|\s \Z")

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.words: dict[str, int] = {}
        self.word_ids: list[np.ndarray] = []
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Tokenise the pieces met for the first time."""
        split = [self.SPLIT.findall(key[1:] if key[:1] == " " else " " + key) for key in self.known.new]
        self.known.new = []
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.words))
        if fresh:
            raw = [w.encode() for w in fresh]
            ids, sizes = self.merges.encode(raw)
            self.word_ids += np.split(ids, np.cumsum(sizes)[:-1])
            base = len(self.words)
            self.words.update(zip(fresh, range(base, base + len(fresh))))
        parts = [[self.word_ids[self.words[w]] for w in ws] for ws in split]
        sizes = np.array([sum(map(len, p)) for p in parts], dtype=np.int64)
        flat = np.concatenate([x for p in parts for x in p]) if sizes.sum() else np.zeros(0, np.int32)
        start = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, flat])
        self.begin, self.count = np.concatenate([self.begin, start]), np.concatenate([self.count, sizes])

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in one array, and the pieces of each text."""
        if len(self.known) > MAX_PIECES:
            self.clear()
        keys: list[str] = []
        per_text = np.zeros(len(texts), dtype=np.int64)
        unsafe = self.UNSAFE.search
        for i, text in enumerate(texts):
            if not text:
                continue
            before = len(keys)
            # pieces cut at a blank hold none, and get theirs back; a leading blank marks those taken as they stand
            if unsafe(text):
                keys += [" " + w for w in self.SPLIT.findall(text)]
            else:
                got = text.split(" ")
                got[0] = " " + got[0]
                keys += got
            per_text[i] = len(keys) - before
        numbers = np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))
        if self.known.new:
            self._learn()
        return numbers, per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and offsets (one more than texts)."""
        pieces, per_text = self.lookup(texts)
        size = self.count[pieces] if len(pieces) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.begin[pieces] - (ends - size), size) + np.arange(total) if total else np.zeros(0, np.int64)
        last = np.cumsum(per_text)
        offsets = np.r_[0, np.r_[0, ends][last]]
        return self.flat[take], offsets

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        pieces, per_text = self.lookup(texts)
        ends = np.r_[0, np.cumsum(self.count[pieces])] if len(pieces) else np.zeros(1, np.int64)
        last = np.cumsum(per_text)
        return ends[last] - ends[last - per_text]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens."""
    path = path or vocabulary_path()
    send_file(texts.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(received(path))
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                ids, offsets = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def token_counts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row: as token_ids, but only lengths leave the worker."""
    path = path or vocabulary_path()
    send_file(texts.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(received(path))
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.lengths(part.column(1).to_pylist()))], names=[id_col, "n_tokens"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint")

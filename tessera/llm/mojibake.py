"""Text decoded with the wrong character encoding: find it and restore the original.

Method. The words with non-ASCII characters are collected with their document counts. From every distinct one
the garbled forms under all encoding chains are generated and hash-joined against the words that occur; a match
whose original is verified is a garbled word. Documents are then joined by their words.

Chains:
* ``multi``: UTF-8 bytes read as a single-byte encoding, once, twice or three times. ASCII stays as it is, so the
  unit is the run of non-ASCII characters within a word: forms are made of runs, and put into the words.
* ``single``: bytes of one single-byte encoding read as another, or as UTF-8 with replacement marks, and either
  of them read wrong once more as in ``multi``. The unit is the whole word.

Verified originals. An original must be clean (no form of anything more common itself) and occur in more documents than
its form, run by run (``multi``) or as a word (``single``); so one garbled document never turns common words into forms.
A ``multi`` word whose original is itself a word of more documents is garbled. Every other match must also have
characters that are clearly more common in their surroundings than the form's: the least count of a changed character between its
neighbours, over all words but those already known as garbled, at least ``LEAST`` and ``RATIO`` times as high.
A word with the replacement mark U+FFFD is garbled in any case, and restored where an original is known.
Of several originals the one in most documents is taken (ties: the larger string).

Only the distinct words are worked on; documents are read once, and joined once with the garbled words.

Defined results
---------------
* null, empty and ASCII texts: never found. * the same text twice: both found or neither.
* very long texts: whole; no word is cut. * words whose original occurs nowhere in clean form, nor its runs: not found,
unless they hold U+FFFD. * empty table: empty result. Extra columns are not carried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: The single-byte encodings that UTF-8 is commonly mistaken for.
MULTI = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
#: What a match needs beside a more common original: so many documents that have its characters in their surroundings, and so many times the form's.
LEAST = 2
RATIO = 1.5
MARK = "�"
#: Java and Python: a word of ASCII letters and non-ASCII characters with at least one of the latter.
WORD = r"(?<![A-Za-z\x{80}-\x{10FFFF}])[A-Za-z]*+[^\x00-\x7F][A-Za-z\x{80}-\x{10FFFF}]*+"
_PY_WORD = re.compile("(?<![A-Za-z\x80-\U0010ffff])[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_RUN = re.compile("[^\x00-\x7f]+")


@functools.cache
def _table(encoding: str) -> list[str]:
    """The character of each byte; bytes the encoding leaves out come out as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def misread(raw: bytes, encoding: str, undefined: str = "control") -> str:
    """Bytes read in an encoding; those it leaves out become control characters, or are replaced or ignored."""
    if undefined != "control":
        return raw.decode(encoding, undefined)
    return "".join(map(_table(encoding).__getitem__, raw))


def multi_forms(run: str) -> set[str]:
    """A run after one, two or three wrong readings of its UTF-8 bytes."""
    steps = [(e, "control") for e in MULTI] + [(e, how) for e in ("cp1252", "cp1250", "cp1251") for how in ("replace", "ignore")]
    once = {s: misread(run.encode(), *s) for s in steps}
    forms = set(once.values())
    for s, form in once.items():
        for t in steps:
            twice = misread(form.encode(), *t)
            forms.add(twice)
            if s == t:
                forms.add(misread(twice.encode(), *t))
    return {f for f in forms if len(f) > 1 and f != run}  # one character may be a letter of its own


@functools.cache
def _writes(encoding: str) -> dict[int, str]:
    """For str.translate: the characters an encoding can write, to themselves as bytes."""
    return {ord(c): chr(b) for b, c in enumerate(_table(encoding)) if b > 127}


def single_forms(word: str) -> dict[str, set[str]]:
    """A word after its single-byte form was read in another encoding, or as UTF-8 with replacement marks: {form: chains}."""
    forms: dict[str, set[str]] = {}
    for source in MULTI:
        writes = _writes(source)
        if any(c > "\x7f" and ord(c) not in writes for c in word):
            continue
        data = word.translate(writes).encode("latin-1")
        for target in MULTI:
            if target != source:
                forms.setdefault(misread(data, target), set()).add(f"{source}>{target}")
        forms.setdefault(data.decode("utf-8", "replace"), set()).add(f"{source}>utf-8")
    forms.pop(word, None)
    return forms


def word_forms(word: str) -> dict[str, set[str]]:
    """The single-byte chains of a word, alone and read wrong once more as UTF-8."""
    forms = single_forms(word)
    for form, chains in list(forms.items()):
        if not form.isascii():
            for target in ("cp1252", "latin-1", "mac_roman"):
                forms.setdefault(misread(form.encode(), target), set()).update(f"{c}>{target}" for c in chains)
    forms.pop(word, None)
    return forms


def _surroundings(word: str) -> set[str]:
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else "o"
    around = f" {word} "
    return {around[i] + ("-" if i == 1 else kind(around[i - 1])) + ("-" if i == len(word) else kind(around[i + 1])) for i in range(1, len(word) + 1) if around[i] > "\x7f"}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (form, original, chains) of the forms of words."""
    for batch in batches:
        got = [(form, w, sorted(chains)) for w in batch.column(0).to_pylist() for form, chains in word_forms(w).items()]
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], names=["form", "original", "chains"])


def _strings(f):
    """Rows (form, original) of a function from a string to strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            got = [(form, w) for w in words for form in f(w)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["form", "original"])

    return run


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words): the distinct words with non-ASCII characters of every document that has any."""
    words = F.array_distinct(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))
    return docs.where(F.col(text_col).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).alias("id"), words.alias("words"))


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, original, sure, single, chains) of the garbled words of (word, df); original is null where none is known.

    Words with fewer than two ASCII letters of a ``single`` chain are not sure: they may be a sign of their own, and
    count only beside a sure one of the same chain.
    """
    runs = words.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]+"), F.lit(0)))).alias("run"), "df", "word")
    by_run = written(runs.groupBy("run").agg(F.sum("df").alias("df")), "runs")
    pair = "form string, original string"
    multi = by_run.select("run").mapInArrow(_strings(multi_forms), pair).hint("merge")  # Spark takes forms for no larger than their words
    multi = multi.join(by_run.select(F.col("run").alias("form"), F.col("df").alias("form_df")), "form").join(by_run.select(F.col("run").alias("original"), "df"), "original").where("df > form_df")
    multi = written(multi.groupBy("form").agg(F.max(F.struct("df", "original")).alias("best")).select("form", "best.original"), "multi")
    # a run read wrong more than once leads to one read wrong less often; document counts rise on the way, so it ends
    for _ in range(2):
        deeper = multi.select(F.col("form").alias("original"), F.col("original").alias("root"))
        multi = multi.join(deeper, "original", "left").select("form", F.coalesce("root", "original").alias("original"))
    multi = written(multi, "multi")
    hit = runs.join(multi.select(F.col("form").alias("run"), "original"), "run").groupBy("word", "df").agg(F.map_from_entries(F.collect_list(F.struct("run", "original"))).alias("fix"))
    original = words.select(F.col("word").alias("original"), F.col("df").alias("original_df"))
    by_runs = written(hit.select(F.col("word").alias("form"), F.col("df").alias("form_df"), _mended("word", "fix").alias("original")).join(original, "original", "left"), "by-runs")
    known = by_runs.where("original_df > form_df").select("form", "original")

    single = words.select("word").where(~F.col("word").contains(MARK)).mapInArrow(_chained, f"{pair}, chains array<string>").hint("merge")
    single = single.join(words.select(F.col("word").alias("form"), F.col("df").alias("form_df")), "form").join(original, "original").where("original_df > form_df")
    single = written(single.join(by_runs.select("form"), "form", "left_anti").join(by_runs.select(F.col("form").alias("original")), "original", "left_anti"), "single")

    # surroundings, of all words but those known as garbled
    plain = words.where(~F.col("word").contains(MARK)).join(known.select(F.col("form").alias("word")), "word", "left_anti")
    common = plain.select("word", "df").mapInArrow(_features, "feature string, df bigint").groupBy("feature").agg(F.sum("df").alias("n"))
    open_ = by_runs.where("original_df is null or original_df <= form_df").select("form", "original").unionByName(single.select("form", "original"))
    changed = open_.mapInArrow(_changes, "form string, original string, of_form boolean, feature string").join(common, "feature", "left")
    score = changed.groupBy("form", "original").agg(*(F.coalesce(F.min(F.when(side, F.coalesce("n", F.lit(0)))), F.lit(0)).alias(name) for name, side in (("form_n", F.col("of_form")), ("original_n", ~F.col("of_form")))))
    verified = written(score.where((F.col("original_n") >= LEAST) & (F.col("original_n") > RATIO * F.col("form_n"))).select("form", "original"), "verified")

    fixed = known.unionByName(by_runs.select("form", "original").join(verified, ["form", "original"], "left_semi")).select(F.col("form").alias("word"), F.col("original").alias("fixed"))
    marked = F.col("form").contains(MARK)
    single = single.join(verified.withColumn("ok", F.lit(True)), ["form", "original"], "left").where(marked | F.col("ok"))
    single = single.groupBy("form").agg(F.max(F.struct("original_df", "original", "chains")).alias("best")).select(F.col("form").alias("word"), F.col("best.original").alias("single"), "best.chains")
    return (
        words.select("word").join(fixed, "word", "left").join(single, "word", "left")
        .where(F.col("fixed").isNotNull() | F.col("single").isNotNull() | F.col("word").contains(MARK))
        .select(
            "word", F.coalesce("fixed", "single").alias("original"),
            (F.col("fixed").isNotNull() | F.col("word").contains(MARK) | F.col("word").rlike("[A-Za-z].*[A-Za-z]")).alias("sure"), F.col("fixed").isNull().alias("single"),
            F.when(F.col("fixed").isNull(), F.col("chains")).alias("chains"),
        )
    )


def _mended(word: str, fix: str):
    """The word with each of its garbled runs replaced; runs are found as the method cuts them."""
    parts = F.regexp_extract_all(word, F.lit(r"[^\x00-\x7F]+|[\x00-\x7F]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(fix, p), p)), "")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(x, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in _surroundings(w)]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], names=["feature", "df"])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the form has and the original has not, and the other way round."""
    for batch in batches:
        rows = []
        for form, original in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = _surroundings(form), _surroundings(original)
            rows += [(form, original, True, x) for x in a - b] + [(form, original, False, x) for x in b - a]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["form", "original", "of_form", "feature"])


class Garbled:
    """The garbled words of a table of documents, and the documents that hold them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.words = written(document_words(docs, id_col, text_col), "doc-words")
        counts = self.words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        self.table = written(garbled_words(written(counts, "words")), "garbled")

    def hits(self) -> DataFrame:
        """(id, word, original, sure, single, chains), one row for each word of a document that is or may be garbled."""
        return self.words.select("id", F.explode("words").alias("word")).join(self.table, "word")

    def found(self) -> DataFrame:
        return self.hits().where("sure").select(F.col("id").alias(self.id_col)).distinct()

    def restored(self) -> DataFrame:
        """(id, text, n_words, n_restored) of the found documents, each known original put in place."""
        word = F.struct("word", "original", F.col("sure").alias("ok"), "single", "chains")
        hits = self.hits().groupBy("id").agg(F.collect_list(word).alias("all")).where(F.exists("all", lambda x: x["ok"]))
        # the chains that account for every sure single word of the document
        sure = F.filter("all", lambda x: x["ok"] & x["single"] & x["chains"].isNotNull())
        chains = F.aggregate(F.slice(sure, 2, 2**30), F.try_element_at(sure, F.lit(1))["chains"], lambda acc, x: F.array_intersect(acc, x["chains"]))
        fixes = hits.withColumn("same", chains).select("id", F.filter("all", lambda x: x["ok"] | F.coalesce(F.arrays_overlap(x["chains"], F.col("same")), F.lit(False))).alias("fixes"))
        rows = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text")).join(fixes, "id")

        id_col = self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, all_, known = [], [], []
                for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    fix = {p["word"]: p["original"] for p in pairs if p["original"] is not None}
                    texts.append(_PY_WORD.sub(lambda m: fix.get(m[0], m[0]), text))
                    all_.append(len(pairs))
                    known.append(len(fix))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(all_, pa.int32()), pa.array(known, pa.int32())], names=[id_col, "text", "n_words", "n_restored"])

        return rows.mapInArrow(run, f"{id_col} {dict(self.docs.dtypes)[id_col]}, text string, n_words int, n_restored int")

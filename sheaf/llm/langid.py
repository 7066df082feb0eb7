"""Language identification, words first: known words by log frequency, others by ever shorter character n-grams."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.common import bucket_of, map_batches

#: Bounds of the fit: labelled documents of each language (drawn by a hash of the id), bytes of a document that is learned
#: from, and languages (those of most documents). All their words count; there is no bound on the vocabulary.
FIT_DOCS, FIT_BYTES, FIT_LANGS = 1000, 1 << 16, 512
GRAMS = (4, 3, 2, 1)
SMOOTH = 0.5
#: Distinct words scored and kept by a Python worker before it starts afresh.
CACHED_WORDS = 100_000

_letters = regex.compile(r"\p{L}+").findall


def words(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


class _Scores(dict):
    """Words to the rows of a table of their scores, made when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[place] = self.model.score(word)
        self[word] = place
        return place


@dataclass
class Model:
    """Log frequencies per language of words and of n-grams: their rows in two tables. Its size is that of the sample's vocabulary."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    cache: _Scores | None = field(default=None, repr=False)

    @classmethod
    def of(cls, counts: list[tuple[str, str, int]]) -> Model:
        """counts: (lang, word, n)."""
        langs = sorted({lang for lang, _, _ in counts})
        place = {lang: i for i, lang in enumerate(langs)}
        known = cls.table(((word, place[lang], n) for lang, word, n in counts), len(langs))
        grams: dict[str, int] = {}
        logs = []
        for size in GRAMS:
            each = ((gram, place[lang], n) for lang, word, n in counts for gram in cls.grams_of(word, size))
            names, table = cls.table(each, len(langs))
            grams.update((g, i + sum(map(len, logs))) for g, i in names.items())
            logs.append(table)
        return cls(langs, *known, grams, np.concatenate(logs))

    @staticmethod
    def table(counts: Iterator[tuple[str, int, int]], width: int) -> tuple[dict[str, int], np.ndarray]:
        """Names to rows, and the rows: smoothed log frequencies in each language."""
        names: dict[str, int] = {}
        rows, columns, values = array("q"), array("q"), array("q")
        for name, column, n in counts:
            rows.append(names.setdefault(name, len(names)))
            columns.append(column)
            values.append(n)
        total = np.zeros((len(names), width))
        np.add.at(total, (np.frombuffer(rows, np.int64), np.frombuffer(columns, np.int64)), np.frombuffer(values, np.int64))
        return names, np.log(total + SMOOTH) - np.log(total.sum(axis=0) + SMOOTH * len(names)) if names else total

    @staticmethod
    def grams_of(word: str, n: int) -> list[str]:
        """Of the word between marks, those of two or more characters; single ones without marks."""
        marked = f"<{word}>" if n > 1 else word
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    def score(self, word: str) -> np.ndarray:
        """The word's own log frequencies, or the means over its known n-grams of the greatest length that has any."""
        if (row := self.words.get(word)) is not None:
            return self.word_logs[row]
        for n in GRAMS:
            if seen := [row for g in self.grams_of(word, n) if (row := self.grams.get(g)) is not None]:
                return self.gram_logs[seen].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Ties go to the language that sorts first. score: its share of the posterior under equal priors."""
        found = words(text)
        if not found or not self.langs:
            return "und", 0.0
        if self.cache is None or len(self.cache) > CACHED_WORDS:
            self.cache = _Scores(self)
        places = np.fromiter(map(self.cache.__getitem__, found), np.int64, len(found))
        total = self.cache.table[places].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def sample(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """lang and text of up to fit_docs documents of each language of (doc_id, text, lang): those of the least hashes of their ids.

    Null ids, texts and languages, and documents above FIT_BYTES, are left out; of rows with the same id and language, one
    counts. Where a language has many, first those below a hash are taken that leaves a little more than enough, so no
    language is sorted as a whole; hashes have 64 bits, so it works at any number of rows.
    """
    labelled = docs.where("lang is not null and doc_id is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_LANGS).collect()
    enough = fit_docs + 8 * fit_docs**0.5 + 8  # the number below a hash varies by its square root
    limits = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, int(enough / r["n"] * 2**64))) for r in sizes]
    few = docs.sparkSession.createDataFrame(limits, "lang string, most long")
    hashed = labelled.where(F.octet_length("text") <= FIT_BYTES).select("doc_id", "lang", "text", F.xxhash64(F.lit("langid"), "doc_id").alias("h"))
    drawn = hashed.join(F.broadcast(few), "lang").where("h <= most").groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text"))
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("place") <= fit_docs).select("lang", "text")


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learns from sample(docs). Only the counts of its words reach the driver, all of them."""

    def count(rows: pa.RecordBatch) -> dict:
        counts: Counter = Counter()
        for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words(text))
        return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

    counted = map_batches(sample(docs, fit_docs), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model.of([(r["lang"], r["word"], r["n"]) for r in counted.collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of (doc_id, text), other columns aside.

    `und` and 0 for a null text, one without a letter, or without a learned language. Ties go to the language that sorts
    first; repeated rows repeat, and an empty table gives none; a long text is scored as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> dict:
        own = shared.value
        out = [own.predict(t) for t in rows.column("text").to_pylist()]
        return {"doc_id": rows.column("doc_id"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]}

    return map_batches(docs.select("doc_id", "text"), batch, "doc_id long, lang_pred string, score double")


def held_out_predictions(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Learns where crc32(doc_id) modulo 3 is not 1, and predicts every row. A null doc_id is never learned from."""
    fold = bucket_of(F.col("doc_id"), 3)
    model = fit(docs.where(fold != 1), fit_docs)
    return predict(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

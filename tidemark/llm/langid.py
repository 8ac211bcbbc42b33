"""Language identification by words first, character n-grams for words not known.

Learning counts words, and the n-grams of the words, per language over labelled
rows.  A word of a text that was learned scores each language by the logarithm
of its frequency there.  One that was not falls back to its longest n-grams of
which at least one is known, from ``LONGEST`` letters down to one, and takes
their mean.  The language with the highest sum over the words is predicted.

The labelled rows learned from are at most about ``TRAIN_ROWS`` (all of them, if
there are no more), chosen by a hash of the id; the model keeps every word and
n-gram seen at least ``LEAST`` times in them.  The rows learned from are the
bound of the fitted model, which is therefore small enough to be sent to all
tasks: as one array of entries and one matrix of their logarithms, from which
only tasks make a look-up table.  Every text is scored whole.

Cases: NULL text or text without a letter is ``und`` with score 0; letters of
which nothing is known get the language with the most training rows (then the
first by name); without any training row all is ``und``; rows with a NULL
language or NULL id teach nothing, and a NULL id is not held out; repeated rows
give equal rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, on_text, sampled, ship, tables
from tidemark.session import stored

TRAIN_ROWS = 8_000
LEAST = 2  # times an entry must have been seen
LONGEST = 5
ABSENT = 0.1  # count of an entry that a language does not have
_REMEMBERED = 250_000
_EVEN = 20  # words after which the score no longer sharpens
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders marked; single letters without the marks."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, entry, n) of a task: words as they are, n-grams after a blank."""
    for batch in rows:
        for lang, texts in batch.groupby("lang")["text"]:
            words = Counter()
            for text in texts:
                words.update(words_of(text))
            grams = Counter()
            for word, n in words.items():
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        grams[f" {gram}"] += n
            for counts in (words, grams) if words else ():
                yield pd.DataFrame({"lang": lang, "entry": list(counts), "n": list(counts.values())})


class Table:
    """Entries and their log frequencies a language, held as two arrays; looked up only in tasks."""

    def __init__(self, entries: pa.Array, logs: np.ndarray):
        self.entries, self.logs, self.places = entries, logs, None

    def __getstate__(self):
        return self.entries, self.logs

    def __setstate__(self, state):
        self.__init__(*state)

    def get(self, entry: str) -> tuple[float, ...] | None:
        if self.places is None:
            self.places = dict(zip(self.entries.to_pylist(), range(len(self.entries))))
        place = self.places.get(entry)
        return None if place is None else tuple(self.logs[place].tolist())


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS, least: int = LEAST) -> dict:
    """The model: languages by weight, and per-language log frequencies of words and n-grams (eager).

    ``labelled`` has text, lang and the id that samples it.  Counts are stored
    once; the driver gets those of the entries kept as Arrow arrays.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = sampled(rows, "doc_id", train_rows)
    weights = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(weights, key=lambda x: (-weights[x], x))
    if not langs:
        return {"langs": [], "words": {}, "grams": {}}
    names = [f"n{k}" for k in range(len(langs))]
    kind = F.when(F.col("entry").startswith(" "), F.length("entry") - 1).otherwise(0)  # 0 for words, else the n of an n-gram
    counts = stored(rows.select("lang", "text").mapInPandas(_counted, "lang string, entry string, n long").groupBy("entry").agg(*[
        F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(name) for name, lang in zip(names, langs)],
        F.sum("n").alias("total")).withColumn("kind", kind))
    totals = {r["kind"]: [max(1, r[name]) for name in names] for r in counts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    model: dict = {"langs": langs}
    for part, wanted in (("words", F.col("kind") == 0), ("grams", F.col("kind") > 0)):
        kept = counts.filter(wanted & (F.col("total") >= least)).select("entry", "kind", *names).toArrow().combine_chunks()
        values = np.stack([kept[name].to_numpy() for name in names], axis=1).astype(float)
        sums = np.array([totals[k] for k in kept["kind"].to_pylist()], dtype=float).reshape(values.shape)
        entries = pc.utf8_ltrim(kept["entry"], " ").combine_chunks()
        model[part] = Table(entries, np.log(np.maximum(values, ABSENT) / sums))
    return model


class _Scores(dict):
    """Scores of words met so far; backs off for those the model does not have."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.none = (0.0,) * len(model["langs"])

    def __missing__(self, word: str) -> tuple[float, ...]:
        known = self.model["words"].get(word)
        if known is None:
            grams = self.model["grams"]
            for n in range(min(LONGEST, len(word) + 2), 0, -1):
                rows = [row for row in map(grams.get, grams_of(word, n)) if row is not None]
                if rows:
                    known = tuple(sum(x) / len(rows) for x in zip(*rows))
                    break
        self[word] = known or self.none
        return self[word]


def predictor(spark: SparkSession, model: dict):
    """Column function: text to lang_pred and score."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own = pickle.loads(sent.value)
        langs, scores = own["langs"], _Scores(own)

        def one(text: str | None) -> dict:
            words = words_of(text)
            if not words or not langs:
                return {"lang_pred": "und", "score": 0.0}
            if len(scores) > _REMEMBERED:
                scores.clear()
            total = np.array(list(map(scores.__getitem__, words))).sum(axis=0)
            best = int(np.argmax(total))
            spread = (total - total[best]) * (min(len(words), _EVEN) / len(words))
            return {"lang_pred": langs[best], "score": float(1 / np.exp(spread).sum())}

        return one

    return on_text(spark, make, "lang_pred string, score double")


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    made = docs.select("doc_id", predictor(docs.sparkSession, model)(F.col("text")).alias("made"))
    return made.select("doc_id", "made.lang_pred", "made.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = tables(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.filter(~held_out))
    made = docs.select("doc_id", held_out.alias("held_out"), predictor(spark, model)(F.col("text")).alias("made"))
    return made.select("doc_id", "held_out", "made.lang_pred", "made.score")

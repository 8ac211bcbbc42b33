"""Toxicity: lexicon terms, also misspelled, judged by the words around them.

The lexicon is learned from labelled rows: words and word beginnings that occur
in toxic documents and hardly elsewhere, chosen one after another by how many
toxic documents each adds.  Matching intersects a Levenshtein automaton (one
edit) with the lexicon's trie; the product automaton is made deterministic as
texts ask for its states, so a word is read once, letter by letter, whatever
the size of the lexicon.  A beginning matches whatever follows it.

Matches (term, with or without an edit) are weighed by two rates: how many a
toxic document has, and how many come about by chance per word of clean ones.
Among N words, a match of a kind weighs by the odds of the own rate against the
chance rate times N; how many matches a toxic document has varies geometrically
around their mean, so one clear match can do and its lack tells little.  The context window moves each match: a word or quotation mark within
``REACH`` tokens adds its log odds between matches in toxic and in clean
documents, so quotation and abuse part as far as the labels show it.  The score
is the probability that results from the share of toxic documents and all evidence.

The model is fitted on about ``TRAIN_ROWS`` labelled rows at most (all, if there
are no more), chosen by a hash of the id, and keeps ``MOST_TERMS`` terms and
``MOST_CONTEXT`` context entries at most; every text is scored whole.

Cases: NULL and empty texts have no match and get the score of documents without one;
rows with a NULL id or NULL label teach nothing; of several labels of one id the
highest counts; without training rows the lexicon is empty and all scores are 0.
A NULL id is not held out; repeated rows give equal rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, on_text, sampled, ship, tables
from tidemark.session import stored

TRAIN_ROWS = 10_000
MOST_CANDIDATES, MOST_TERMS, MOST_CONTEXT = 20_000, 2_000, 5_000
LEAST_DOCS, LEAST_SHARE = 3, 0.02  # toxic documents that a term has to add, at least this many and this share
LEAST_ODDS = math.log(3)
CLEAN_COST = 0.5  # toxic documents that a clean one weighs up when terms are chosen
DEPTH = 4  # terms that a toxic document may bring in
SHORTEST = 4  # letters of a term
FUZZY_WORD, FUZZY_STEM = 5, 8  # letters from which one edit is allowed
REACH = 6
MISSPELT = 0.05  # misspelled matches to a right one, at least
PREDICT = 0.7
CONTEXT_MOST, CONTEXT_SEEN = 3.0, 5  # most that a window moves a match; matches a context entry must be seen at
_REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‘’]")
_OTHER = "\0"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Matcher:
    """Product of the lexicon's trie with a Levenshtein automaton of one edit.

    A term ending in ``*`` is a beginning.  ``find`` returns (term, edits) of
    the best match of a word, or None.
    """

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, str, bool] | None] = [None]
        self.fuzzy: list[bool] = [False]  # whether some term below a node allows an edit
        for term in sorted(terms):
            stem = term.rstrip("*")
            opened = stem != term
            allowed = len(stem) >= (FUZZY_STEM if opened else FUZZY_WORD)
            node = 0
            for letter in stem:
                self.fuzzy[node] |= allowed
                after = self.children[node].get(letter)
                if after is None:
                    after = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.fuzzy.append(False)
                node = after
            self.fuzzy[node] |= allowed
            if self.ends[node] is None or opened:
                self.ends[node] = (allowed, term, opened)
        self.letters = {letter for below in self.children for letter in below}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._spread({(0, 0)}))

    def _spread(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the states reached by leaving out a letter of a term."""
        more = {(child, 1) for node, edits in pairs if edits == 0 for child in self.children[node].values() if self.fuzzy[child]}
        return frozenset(pairs | more)

    def _state(self, pairs: frozenset) -> int:
        known = self.states.get(pairs)
        if known is None:
            known = self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            ends = [(edits, self.ends[node][1]) for node, edits in pairs
                    if self.ends[node] and (edits == 0 or self.ends[node][0])]
            best = min(ends, default=None)
            self.accepts.append((best[1], best[0]) if best else None)
        return known

    def _move(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                after.add((child, edits))
            end = self.ends[node]
            if end and end[2] and (edits == 0 or end[0]):
                after.add((node, edits))  # what follows a beginning is free
            if edits == 0 and self.fuzzy[node]:
                after.add((node, 1))  # a letter too many
                after.update((other, 1) for other in self.children[node].values() if self.fuzzy[other])  # another letter
        target = self._state(self._spread(after)) if after else self.dead
        self.moves[state][letter] = target
        return target

    def find(self, word: str) -> tuple[str, int] | None:
        state, moves, dead, letters = self.start, self.moves, self.dead, self.letters
        for letter in word:
            if letter not in letters:
                letter = _OTHER
            after = moves[state].get(letter)
            state = self._move(state, letter) if after is None else after
            if state == dead:
                return None
        return self.accepts[state]


class _Found(dict):
    """Words matched so far."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> tuple[str, int] | None:
        out = self[word] = self.matcher.find(word)
        return out


def matches(text: str | None, found: _Found, words: list[str] | None = None) -> list[tuple[str, int, set[str]]]:
    """(term, edits, tokens around) of every matched word."""
    if len(found) > _REMEMBERED:
        found.clear()
    if not text or not any(map(found.__getitem__, words_of(text) if words is None else words)):
        return []
    tokens = _TOKEN.findall(text.lower())
    out = []
    for i, token in enumerate(tokens):
        hit = found[token]
        if hit:
            out.append((*hit, set(tokens[max(0, i - REACH):i] + tokens[i + 1:i + 1 + REACH])))
    return out


def entries_of(text: str | None) -> set[str]:
    """Words of a text that could be terms, and their beginnings marked by ``*``."""
    out = set()
    for word in set(words_of(text)):
        if len(word) >= SHORTEST and not word[0].isdigit():
            out.add(word)
            out.update(word[:i] + "*" for i in range(SHORTEST, min(len(word), 12)))
    return out


def choose(postings: dict[str, set[int]], clean: dict[str, int], per_toxic: float, least: float = LEAST_DOCS, most: int = MOST_TERMS) -> list[str]:
    """Terms one after another by the toxic documents each adds, less the clean ones it would catch.

    A document is done with when ``DEPTH`` terms have it.  Of equals the longer
    is taken, then the first by name; one that begins as a chosen beginning does
    is passed over.
    """
    chosen: list[str] = []
    left = dict(postings)
    times = Counter()
    done: set[int] = set()
    while left and len(chosen) < most:
        gain = {term: len(docs - done) - per_toxic * clean[term] for term, docs in left.items()}
        left = {term: docs for term, docs in left.items() if gain[term] >= least}
        if not left:
            break
        best = min(left, key=lambda t: (-gain[t], -len(t.rstrip("*")), t))
        chosen.append(best)
        times.update(left.pop(best))
        done = {doc for doc, n in times.items() if n >= DEPTH}
        stem = best.rstrip("*")
        left = {t: docs for t, docs in left.items() if not (best != stem and t.startswith(stem)) and not (
            t.endswith("*") and best.startswith(t.rstrip("*")))}
    return chosen


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model, from documents whose id is in ``labels`` (doc_id, toxic); eager, a few small collects."""
    spark = docs.sparkSession
    ship(spark)
    labels = (labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic"))
              .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # At most about train_rows rows of two numbers: small enough for every task.
    chosen = F.broadcast(sampled(labels, "doc_id", train_rows))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(chosen, "doc_id")
    rows = rows.select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    model = {"terms": [], "rates": {}, "context": {}, "own": 0.0, "prior": -math.inf}
    if not toxic:
        return model

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, texts in batch.groupby("toxic")["text"]:
                counts = Counter()
                for text in texts:
                    counts.update(entries_of(text))
                if not counts:
                    continue
                yield pd.DataFrame({"entry": list(counts), "t": [n * kind for n in counts.values()],
                                    "c": [n * (not kind) for n in counts.values()]})

    odds = (F.log((F.col("t") + 0.5) / F.lit(toxic + 1)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1)))
    candidates = (rows.select("toxic", "text").mapInPandas(counted, "entry string, t long, c long")
                  .groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                  .filter((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS))
                  .orderBy(F.desc("t"), "entry").limit(MOST_CANDIDATES).toPandas())
    names = spark.sparkContext.broadcast(frozenset(candidates["entry"]))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(i, e) for i, text in zip(batch["doc_id"], batch["text"]) for e in entries_of(text) & names.value]
            if pairs:
                yield pd.DataFrame(pairs, columns=["doc_id", "entry"])

    postings: dict[str, set[int]] = {}
    for doc, entry in rows.filter("toxic").select("doc_id", "text").mapInPandas(posted, "doc_id long, entry string").toPandas().itertuples(index=False):
        postings.setdefault(entry, set()).add(doc)
    model["terms"] = choose(postings, dict(zip(candidates["entry"], candidates["c"])), max(CLEAN_COST, toxic / max(1, clean)),
                            max(LEAST_DOCS, LEAST_SHARE * toxic))
    sent = spark.sparkContext.broadcast(pickle.dumps(model["terms"]))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _Found(Matcher(pickle.loads(sent.value)))
        counts = Counter()
        for batch in batches:
            for text, is_toxic in zip(batch["text"], batch["toxic"]):
                counts["words", "", bool(is_toxic)] += len(words_of(text))
                for term, edits, around in matches(text, found):
                    counts["fuzzy" if edits else "exact", term, bool(is_toxic)] += 1
                    counts.update((f"context {'fuzzy' if edits else 'exact'} {term}", token, bool(is_toxic)) for token in around)
        if counts:
            yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "key", "toxic", "n"])

    told = stored(rows.select("text", "toxic").mapInPandas(judged, "kind string, key string, toxic boolean, n long")
            .groupBy("kind", "key").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"),
                                        F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c")))
    context = F.col("kind").startswith("context ")
    seen = {(r["kind"], r["key"]): (r["t"], r["c"]) for r in told.filter(~context).collect()}  # two rows a term at most
    words_t, words_c = seen.get(("words", ""), (0, 0))
    for (kind, key), (t, c) in seen.items():
        if kind != "words":
            chance = (c + 0.5) / (words_c + 1)
            model["rates"][kind, key] = (max(0.0, t - chance * words_t) / toxic, chance)
    for (kind, key), (own, _) in list(model["rates"].items()):  # a misspelling that was never seen is still one
        if kind == "exact":
            seen_own, chance = model["rates"].get(("fuzzy", key), (0.0, 0.5 / (words_c + 1)))
            model["rates"]["fuzzy", key] = (max(seen_own, MISSPELT * own), chance)
    # What a token tells beyond the term it stands by: its toxic matches against those its terms lead to expect.
    shares = [(f"context {kind} {key}", t / (t + c)) for (kind, key), (t, c) in seen.items() if kind != "words"]
    if shares:
        expected = spark.createDataFrame(shares, "kind string, share double")
        around = (told.filter(context).join(F.broadcast(expected), "kind").groupBy("key").agg(
            F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") + F.col("c")) * F.col("share")).alias("e"))
            .filter(F.col("t") + F.col("c") >= CONTEXT_SEEN).orderBy(F.desc(F.col("t") + F.col("c")), "key").limit(MOST_CONTEXT))
        for r in around.collect():
            rest = r["t"] + r["c"] - r["e"]
            model["context"][r["key"]] = (math.log((r["t"] + CONTEXT_SEEN) / (r["e"] + CONTEXT_SEEN))
                                          - math.log((r["c"] + CONTEXT_SEEN) / (rest + CONTEXT_SEEN)))
    model["own"] = sum(own for own, _ in model["rates"].values())
    model["prior"] = math.log(toxic / max(0.5, clean))
    return model


def probability(model: dict, words: int, hits: list[tuple[str, int, set[str]]]) -> float:
    """Score of a text of ``words`` words with these matches."""
    odds, meant = model["prior"], 0
    for term, edits, around in hits:
        own, chance = model["rates"].get(("fuzzy" if edits else "exact", term), (0.0, 1.0))
        moved = sum(model["context"].get(token, 0.0) for token in around)
        ratio = own / (chance * max(1, words))
        meant += ratio > 1
        odds += math.log1p(ratio) + max(-CONTEXT_MOST, min(CONTEXT_MOST, moved))
    odds += math.lgamma(meant + 1) - (meant + 1) * math.log1p(model["own"])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))) if odds > -math.inf else 0.0


def scorer(spark: SparkSession, model: dict):
    """Column function: text to its score."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own = pickle.loads(sent.value)
        found = _Found(Matcher(own["terms"]))

        def one(text: str | None) -> float:
            words = words_of(text)
            return probability(own, len(words), matches(text, found, words))

        return one

    return on_text(spark, make, "double")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the folds learned from."""
    return labels.filter(fold("doc_id", 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    model = learn(docs, training_labels(labels))
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                         scorer(spark, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))


def clean_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text")) < PREDICT)

"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the weighted set of its word shingles (five words; weights count
occurrences), and two are linked if their weighted Jaccard similarity is at
least 0.8.  Signatures follow the dart-throwing scheme: every shingle owns a
strip of the plane, unit by unit of weight, on which hashed darts fall at unit
rate along a rank axis.  Darts within a document's weights are thrown up to the
rank at which all ``COORDINATES`` are hit; each dart belongs to one coordinate,
and the earliest one there is the signature's value.  Two documents agree in a
coordinate with the probability of their similarity.  A long document needs
darts of low rank only, so its signature costs little more than a short one's.

Equal word sequences are made one first.  Bands of ``ROWS`` values are then
joined.  Within a bucket everything is compared with ``PIVOTS`` of its members, the
smallest id and those with the least of some hashes of the id, so a bucket of n
documents costs a few times n comparisons and no group is ever gathered.  Other
buckets of the same documents mostly have the same pivots.  Every comparison is exact, on the texts.  Components of the
links found are numbered.  Of buckets that then still hold several components,
members of different components are compared, part by part of the bucket, where
their signatures agree in enough coordinates (all but 3 of 100,000 linked pairs
do), in the first bucket they share.  No candidate of the bands is dropped otherwise; a linked pair of similarity 0.8 shares no band in about
5 of a million cases.

Cases: texts of fewer than five words are one shingle; NULL texts and texts
without a word are alone in their class; rows with a NULL id have a NULL class
and are compared with nothing; rows that repeat an id count as one document
(of several texts of one id, all are compared); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import on_text, ship, tables
from tidemark.llm.components import components
from tidemark.session import stored

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 6
PIVOTS = 4
PART = 500
COORDINATES = BANDS * ROWS
_MULT, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EDGES = np.concatenate([[0.0], 2.0 ** np.arange(-4, 1), np.arange(2.0, 4096.0)])  # cells of the rank axis
_WIDTHS = np.diff(_EDGES)
_REMEMBERED = 500_000
_HELD = 3_000_000
_WORD = re.compile(r"[^\W_]+")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _share(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """Distribution function of a Poisson count, as far as doubles tell."""
    steps, term, total, n = [], np.exp(-mean), 0.0, 0
    while total + term < 1 - 1e-15 and n < 40:
        total += term
        steps.append(total)
        n += 1
        term *= mean / n
    return np.array(steps)


_STEPS = {w: _poisson_steps(w) for w in set(_WIDTHS.tolist())}


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """DartMinHash of a weighted set: for each coordinate the earliest dart within the weights.

    ``elements`` are distinct 64-bit hashes, ``weights`` positive numbers.
    """
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    strips = mixed(elements[owner] + _MULT * (level + 1).astype(np.uint64))
    reach = np.minimum(weights[owner] - level, 1.0)  # of each unit strip, the part within the weight
    enough = coordinates * (np.log(coordinates) + 3)
    limit = enough / float(weights.sum())
    while True:
        cells = min(max(1, int(np.searchsorted(_EDGES, limit))), len(_WIDTHS))
        seeds = mixed(strips[:, None] ^ (_MULT * np.arange(1, cells + 1, dtype=np.uint64))[None, :])
        chance = _share(seeds)
        counts = np.empty(seeds.shape, dtype=np.int64)
        for width in set(_WIDTHS[:cells].tolist()):
            of = np.flatnonzero(_WIDTHS[:cells] == width)
            counts[:, of] = np.searchsorted(_STEPS[width], chance[:, of], side="right")
        flat = counts.ravel()
        hit = np.flatnonzero(flat)
        number = flat[hit]
        cell = np.repeat(hit, number)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(number) - number, number)
        dart = mixed(seeds.ravel()[cell] + _MULT * (nth + 1).astype(np.uint64))
        column = cell % cells
        rank = _EDGES[column] + _WIDTHS[column] * _share(mixed(dart ^ _MIX1))
        part = reach[cell // cells]
        if (part < 1).any():
            within = (part >= 1) | (_share(mixed(dart ^ _MIX2)) < part)
            dart, rank = dart[within], rank[within]
        coordinate = (mixed(dart ^ _MULT) % np.uint64(coordinates)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        first = np.full(coordinates, -1, dtype=np.int64)
        first[coordinate[order]] = order  # the last one written is the earliest
        if (first >= 0).all() or cells == len(_WIDTHS):
            return np.where(first >= 0, dart[np.maximum(first, 0)], np.uint64(0))
        limit *= 2


class _Hashes(dict):
    """64-bit hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(text: str | None, known: dict) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    if len(known) > _REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a word sequence and how often each occurs."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    take = max(1, len(words) - size + 1)
    out = np.zeros(take, dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out * _MIX2 + words[i:i + take] + np.uint64(i + 1))
    elements, counts = np.unique(out, return_counts=True)
    return elements, counts.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (sorted elements)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    shared = np.where(a[0][at] == b[0], np.minimum(a[1][at], b[1]), 0.0).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def signer(spark: SparkSession, bands: int = BANDS, rows: int = ROWS):
    """Column function: text to the hash of its words (NULL without any), its band keys and a byte of every coordinate."""

    def make():
        known = _Hashes()

        def one(text: str | None) -> dict:
            words = word_hashes(text, known)
            if not len(words):
                return {"content": None, "keys": None, "code": None}
            values = dart_signature(*shingles(words), bands * rows).reshape(bands, rows)
            keys = np.arange(1, bands + 1, dtype=np.uint64) * _MULT
            for i in range(rows):
                keys = mixed(keys * _MIX2 + values[:, i])
            return {"content": xxhash.xxh128_digest(words.tobytes()), "keys": keys.view(np.int64),
                    "code": (mixed(values) & np.uint64(255)).astype(np.uint8).tobytes()}

        return one

    return on_text(spark, make, "content binary, keys array<long>, code binary")


def _compared(similar: float):
    """Rows whose two texts are similar, exactly; weighted sets are remembered up to ``_HELD`` elements."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        sets: dict[int, tuple] = {}
        held = 0

        def weighted(node: int, text: str) -> tuple:
            nonlocal held
            if node not in sets:
                if held > _HELD:
                    sets.clear()
                    held = 0
                sets[node] = shingles(word_hashes(text, known))
                held += len(sets[node][0])
            return sets[node]

        for batch in batches:
            rows = zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])
            yield pd.DataFrame([(i, j) for i, j, x, y in rows if similarity(weighted(i, x), weighted(j, y)) >= similar], columns=["a", "b"])

    return run


def compared(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The candidate pairs (a, b) that are similar; ``texts`` (id, text) has one row per id."""
    ship(pairs.sparkSession)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            .mapInPandas(_compared(similar), "a long, b long"))


def classes(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``: class_id is the smallest id among its near duplicates.

    Eager: intermediate tables are written to the shared checkpoint folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    signed = stored(texts.select("id", signer(spark, bands, rows)(F.col("text")).alias("s")).select("id", "s.content", "s.keys", "s.code"))
    known = signed.filter("id IS NOT NULL AND content IS NOT NULL")
    # One representative for equal word sequences, combined before the shuffle.
    groups = stored(known.groupBy("content").agg(F.min("id").alias("rep"), F.min_by(F.struct("keys", "code"), "id").alias("s")).select("content", "rep", "s.keys", "s.code"))
    banded = groups.select("rep", F.posexplode("keys").alias("band", "key"))
    buckets = (banded.groupBy("key").agg(
        F.array(*[F.min_by("rep", F.xxhash64(F.col("rep"), F.lit(k))) if k else F.min("rep") for k in range(PIVOTS)]).alias("pivots"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # Members of buckets of two or more, each beside its pivots.
    members = stored(banded.join(buckets, "key"))
    pivots = F.explode("pivots").alias("b")
    pairs = members.select(F.col("rep").alias("a"), pivots).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # An id that repeats with several texts is stood for by the first of them in text order.
    needed = stored(texts.join(members.select(F.col("rep").alias("id")).distinct(), "id").groupBy("id").agg(F.min("text").alias("text")))
    links = stored(compared(pairs, needed, similar))
    labels = components(links)
    # What is left: members of one bucket in different components that the signatures do not tell apart.
    rest = _undecided(members, labels, groups.select("rep", "keys", "code"), needed)
    kind = _far_links(similar, _floor(similar, bands * rows))
    found = stored(rest.groupBy("key", "i", "j").applyInPandas(kind, "a long, b long"))
    if not found.isEmpty():
        labels = components(found, labels)
    named = groups.select("content", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "content", F.coalesce("label", "rep").alias("class_id"))
    return signed.join(named, "content", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def _floor(similar: float, coordinates: int) -> float:
    """Share of equal coordinates that pairs of this similarity fall below in about 3 of 100,000 cases."""
    return similar - 4 * math.sqrt(similar * (1 - similar) / coordinates)


def _undecided(members: DataFrame, labels: DataFrame, codes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, band, i, j, part, rep, label, keys, code, text) of members, other than pivots, of buckets that hold several components.

    A bucket is cut into parts of about ``PART`` members, and each pair of parts
    is a group of its own.  Pivots have been compared with all of their bucket.
    """
    inner = members.filter(~F.array_contains("pivots", F.col("rep"))).join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep"))
    several = (inner.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
               .filter("low <> high").select("key", "parts"))
    left = inner.select("key", "band", "rep", "label").join(several, "key").join(codes, "rep").join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    part, other = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return left.select("key", "band", "rep", "label", "keys", "code", "text", part.alias("part"), other.alias("other")).select(
        "key", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "label", "keys", "code", "text")


def _far_links(similar: float, floor: float):
    """Links between members of different components, among pairs with at least the share ``floor`` of equal coordinates.

    A pair that shares several buckets is compared in the first one only.  The band keys tell which that is:
    the bytes of a whole band can agree where its values, and so its buckets, differ.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group["code"]])
        keys = np.stack(list(group["keys"]))
        label, rep, text, band = group["label"].to_numpy(), group["rep"].to_numpy(), group["text"].to_numpy(), group["band"].iloc[0]
        first, second = (np.flatnonzero((group["part"] == group[side]).to_numpy()) for side in ("i", "j"))
        known = _Hashes()
        sets: dict[int, tuple] = {}
        out = []
        for x in first:
            apart = second[(label[second] != label[x]) & ((rep[second] > rep[x]) | (group["i"].iloc[0] != group["j"].iloc[0]))]
            if not len(apart):
                continue
            apart = apart[(codes[apart] == codes[x]).mean(axis=1) >= floor]
            near = apart[(keys[apart] == keys[x]).argmax(axis=1) == band]
            for y in near:
                for z in (x, y):
                    if z not in sets:
                        sets[z] = shingles(word_hashes(text[z], known))
                if similarity(sets[x], sets[y]) >= similar:
                    out.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def without_duplicates(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of ``docs``, all columns, less all but the smallest id of each class."""
    gone = classes(docs, **settings).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(*tables(spark, sf_dir, "documents"))

"""Alignment of two tokenizers over every text, as an Arrow pipeline in tasks.

A block of texts is encoded by both vocabularies.  Neither ever joins a token
over a space that follows other than white space, so texts are cut there,
a stretch is encoded when it is first met, and the token lists of texts are
taken from theirs.  They are flattened, parent indices say which text a token is of, and a running sum of
token bytes, taken anew for every text, gives the place where each token ends.
A hash join of the two sets of (document, end) keys leaves the common ends,
which cut the tokens into groups; a second hash join on the group makes the
links, which ``group_by`` counts for each document and pair of ids.  Counts of
documents are made per block, added up by Spark, and come back to the blocks
that hold the pair: a pair crosses the network once a block, not once a
document, and a pair that every document has is one row a block like any other.

A block is cut by bytes of text, and links of a long group are made in slices
of a bounded number, so memory does not depend on how long a text or how
badly matched a passage is.  The table of best counts has at most one row an id
of the first vocabulary, which bounds its broadcast.

Cases: NULL and empty texts, and texts whose tokens of either side are not byte
for byte the text with its leading space, have no tokens: zeros and an empty
``groups_sha256``.  Ids count for nothing: NULL and repeated ids give a row
each, and rows that repeat count as documents of their own.  Counts that tie for
the highest are all best.  An empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tables
from tidemark.session import stored

FIRST_FILE, SECOND_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20  # of text whose pairs are counted together
SLICE_BYTES = 2 << 20  # of text that is encoded and aligned at once
MOST_LINKS = 1 << 22  # made at once
ROW = 5_000  # stretches encoded in a row
REMEMBERED = 400_000  # stretches after which a worker begins anew
_PAIR_BITS = 15  # of a pair's code, for the second id
_CODE_BITS = 31  # of a pair's code
_ID_BITS = 16  # of an id
_END_BITS = 32  # of a key, for the place inside a document
# A single space between other than white space: a border of pre-tokens for the one side, and one no piece spans for the other.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs array<int>, times array<long>"


# -- vocabularies ------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: printable ones as they are, the rest after U+00FF in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: stretches of text, each with a space before it, to lists of ids, and what each id stands for."""

    def __init__(self, encode, contents: Sequence[bytes]):
        self.encode = encode
        self.contents = pa.array(contents, pa.binary())
        self.sizes = pc.binary_length(self.contents).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(contents))])

    def _lists(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and where those of each text start, with the end of the last."""
        lists = self.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))])
        return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1])), offsets

    def ids(self, stretches: Sequence[str], sizes: np.ndarray) -> pa.ListArray:
        """Ids of stretches without white space at their ends; ``sizes`` are their bytes.

        They are encoded in a row, as they stand in texts, and told apart by
        where their bytes end; should an end be inside a token, one by one.
        """
        rows = [" ".join(stretches[k:k + ROW]) for k in range(0, len(stretches), ROW)]
        flat, offsets = self._lists(rows)
        ends = np.cumsum(self.sizes.take(pa.array(flat)).to_numpy())
        wanted = np.cumsum(sizes + 1)
        at = np.searchsorted(ends, wanted)
        if len(wanted) and (at[-1] != len(ends) - 1 or (ends[at] != wanted).any()):
            flat, offsets = self._lists(stretches)
        else:
            offsets = np.concatenate([[0], at + 1])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))

    def alone(self, stretches: Sequence[str]) -> pa.ListArray:
        flat, offsets = self._lists(stretches)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def byte_level(content: bytes) -> Side:
    """A byte-level vocabulary; a text is encoded with a leading space, and strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(content.decode())
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    letters = byte_letters()
    by_id = {i: t for t, i in own.get_vocab().items()}
    contents = [bytes(letters[c] for c in by_id[i]) if i in by_id and set(by_id[i]) <= letters.keys() else by_id.get(i, "").encode()
                for i in range(max(by_id) + 1)]
    return Side(lambda texts: [e.ids for e in own.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], contents)


def pieces(content: bytes) -> Side:
    """A vocabulary of pieces with byte fallback, which adds the leading space itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=content)
    contents = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
                for i in range(own.get_piece_size())]
    return Side(lambda texts: own.encode(list(texts), num_threads=1), contents)


# -- a slice of texts --------------------------------------------------------

def _whole(ids: pa.ListArray, side: Side, wanted: Sequence[bytes]) -> np.ndarray:
    """Which stretches the bytes of their tokens spell out."""
    flat = ids.flatten()
    joined = side.contents.take(flat)
    ends = np.concatenate([[0], np.cumsum(side.sizes.take(flat).to_numpy())])[ids.offsets.to_numpy()]
    data = memoryview(joined.buffers()[2]).cast("B") if len(flat) else memoryview(b"")
    return np.array([data[s:e] == w for s, e, w in zip(ends, ends[1:], wanted)], dtype=bool)


class Stretches:
    """Token lists of the stretches met so far, by both sides; begins anew when it holds many."""

    def __init__(self, a: Side, b: Side, most: int = REMEMBERED):
        self.sides, self.most = (a, b), most
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.lists = [pa.array([], pa.list_(pa.int32()))] * 2
        self.whole = np.zeros(0, dtype=bool)

    def _add(self, kinds: list[str]) -> None:
        # Stretches at the ends of texts may have white space there, and the sign for a space is not its own bytes.
        kinds.sort(key=lambda k: not k or k[0].isspace() or k[-1].isspace() or "▁" in k)
        wanted = [f" {k}".encode() for k in kinds]
        sizes = np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted)) - 1
        plain = sum(not (not k or k[0].isspace() or k[-1].isspace() or "▁" in k) for k in kinds)
        lists = [pa.concat_arrays([side.ids(kinds[:plain], sizes[:plain]), side.alone(kinds[plain:])]) for side in self.sides]
        whole = np.logical_and.reduce([_whole(ids, side, wanted) for ids, side in zip(lists, self.sides)])
        self.places.update(zip(kinds, range(len(self.places), len(self.places) + len(kinds))))
        self.lists = [pa.concat_arrays([old, new]) for old, new in zip(self.lists, lists)]
        self.whole = np.concatenate([self.whole, whole])

    def of(self, kinds: list[str]) -> np.ndarray:
        """The places of different stretches."""
        if len(self.places) > self.most:
            self._clear()
        new = [k for k in kinds if k not in self.places]
        if new:
            self._add(new)
        return np.fromiter(map(self.places.__getitem__, kinds), dtype=np.int64, count=len(kinds))


def encoded(texts: Sequence[str], known: Stretches) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Which texts both sides spell out, and the token lists of those."""
    parts = [_CUT.split(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))])
    stretches = pa.array(chain.from_iterable(parts), pa.large_string(), size=int(offsets[-1])).dictionary_encode()
    del parts
    index = known.of(stretches.dictionary.to_pylist())[stretches.indices.to_numpy()]
    bad = np.concatenate([[0], np.cumsum(~known.whole[index])])[offsets]
    good = bad[1:] == bad[:-1]
    kept = np.repeat(good, np.diff(offsets))
    taken = pa.array(index[kept])
    starts = np.concatenate([[0], np.cumsum(np.diff(offsets)[good])])
    out = []
    for ids in known.lists:
        own = ids.take(taken)
        out.append(pa.ListArray.from_arrays(pa.array(own.offsets.to_numpy()[starts]), own.flatten()))
    return good, *out


def _ends(ids: pa.ListArray, side: Side) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the document of each, and its (document, end) key: a running sum of bytes less that before the document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    sizes = side.sizes.take(flat)
    run = pc.cumulative_sum(sizes)
    starts = ids.offsets.slice(0, len(ids)).cast(pa.int64())
    before = pc.subtract(run.take(starts), sizes.take(starts))
    end = pc.subtract(run, before.take(doc))
    return flat, doc, pc.add(pc.shift_left(doc, _END_BITS), end)


def _groups(key_a: pa.Array, key_b: pa.Array) -> tuple[pa.Array, ...]:
    """For both sides whether each token ends a group, and the number of its group in the slice.

    The ends that both sides have come from a hash join of their keys.
    """
    sides = [pa.table({"end": key, name: pa.array(np.arange(len(key)))}) for key, name in ((key_a, "at_a"), (key_b, "at_b"))]
    common = sides[0].join(sides[1], "end", join_type="inner", use_threads=False)
    out = []
    for key, name in ((key_a, "at_a"), (key_b, "at_b")):
        last = np.zeros(len(key), dtype=bool)
        last[common[name].to_numpy()] = True
        out += [pa.array(last), pc.subtract(pc.cumulative_sum(pa.array(last.astype(np.int64))), pa.array(last.astype(np.int64)))]
    return tuple(out)


def _strings(ids: pa.Array, last: pa.Array, side: Side) -> pa.Array:
    """Ids of every group, comma-joined."""
    stops = pc.add(pc.indices_nonzero(last), 1).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), stops])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, side.names.take(ids)), ",")


def _counted(group: pa.Array, ids: pa.Array) -> pa.Table:
    """(group, id, count_all): how often each group has each id."""
    key = pc.bit_wise_or(pc.shift_left(group, _ID_BITS), ids.cast(pa.int64()))
    made = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    return pa.table({"group": pc.shift_right(made["key"], _ID_BITS), "id": pc.bit_wise_and(made["key"], (1 << _ID_BITS) - 1),
                     "count_all": made["count_all"]})


def links(first: pa.Table, second: pa.Table, doc_of: pa.Array, most: int = MOST_LINKS) -> pa.Table:
    """(key, times): (document, pair of ids that share a group), with how many pairs of occurrences each stands for.

    ``first`` and ``second`` hold (group, id, count_all).  Rows of ``first`` are
    taken in slices that meet at most ``most`` rows of ``second``, or one row.
    """
    width = np.bincount(second["group"].to_numpy(), minlength=len(doc_of))
    reach = np.cumsum(width[first["group"].to_numpy()])
    made, at = [], 0
    while at < len(reach):
        base = reach[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(reach, base + most, side="right")))
        met = first.slice(at, upto - at).join(second, "group", join_type="inner", right_suffix="_b", use_threads=False)
        pair = pc.bit_wise_or(pc.shift_left(met["id"], _PAIR_BITS), met["id_b"])
        doc = doc_of.take(met["group"].combine_chunks())
        rows = pa.table({"key": pc.bit_wise_or(pc.shift_left(doc, _CODE_BITS), pair), "times": pc.multiply(met["count_all"], met["count_all_b"])})
        made.append(rows.group_by("key", use_threads=False).aggregate([("times", "sum")]))
        at = upto
    if not made:
        return pa.table({"key": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    if len(made) == 1:
        return made[0].rename_columns({"times_sum": "times"})
    again = pa.concat_tables(made).group_by("key", use_threads=False).aggregate([("times_sum", "sum")])
    return again.rename_columns({"times_sum_sum": "times"})


def _listed(doc: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Values in order of their documents as one list a document."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def align(texts: Sequence[str | None], known: Stretches, most: int = MOST_LINKS) -> dict[str, pa.Array]:
    """Columns n_a, n_b, n_groups, n_links, groups, pairs and times of some texts (``groups`` as text)."""
    n, (a, b) = len(texts), known.sides
    asked = np.array([bool(t) for t in texts])
    places = np.flatnonzero(asked)
    some = [texts[i] for i in places]
    good, ids_a, ids_b = encoded(some, known)
    places = places[good]
    size = len(places)
    flat_a, doc_a, key_a = _ends(ids_a, a)
    flat_b, doc_b, key_b = _ends(ids_b, b)
    last_a, group_a, last_b, group_b = _groups(key_a, key_b)
    doc_of = doc_a.filter(last_a)
    joined = pc.binary_join_element_wise(_strings(flat_a, last_a, a), _strings(flat_b, last_b, b), "|")
    strings = pc.binary_join(_listed(doc_of.to_numpy(), joined, size), ";")
    made = links(_counted(group_a, flat_a), _counted(group_b, flat_b), doc_of, most)
    key = made["key"].to_numpy()
    order = np.argsort(key)
    key, times = key[order], made["times"].combine_chunks().take(pa.array(order))
    doc, pair = key >> _CODE_BITS, pa.array((key & ((1 << _CODE_BITS) - 1)).astype(np.int32))
    n_links = np.zeros(size, dtype=np.int64)
    np.add.at(n_links, doc, times.to_numpy())
    # Documents without tokens get zeros and empty lists.
    spread = np.full(n, -1)
    spread[places] = np.arange(size)
    where = pa.array(spread, mask=spread < 0)

    def full(values, empty):
        return pc.fill_null(values.take(where), empty)

    def counts(parents):
        return full(pa.array(np.bincount(parents, minlength=size).astype(np.int64)), 0)

    def lists(values):
        taken = _listed(doc, values, size).take(where)
        sizes = pc.fill_null(pc.list_value_length(taken), 0).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), taken.flatten())

    return {"n_a": counts(doc_a.to_numpy()), "n_b": counts(doc_b.to_numpy()), "n_groups": counts(doc_of.to_numpy()),
            "n_links": full(pa.array(n_links), 0), "groups": full(strings, ""), "pairs": lists(pair),
            "times": lists(times)}


def _cut(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of together at most ``most`` bytes, or one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = 4 * len(text) if text and not text.isascii() else len(text or "")
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


# -- tables ------------------------------------------------------------------

def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, block_bytes: int = BLOCK_BYTES,
            slice_bytes: int = SLICE_BYTES, text: bool = False) -> DataFrame:
    """Per document its groups and counted links, with the number of its block; ``text`` adds the groups as text."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    # The files' contents go to the tasks, since their place is the driver's; a few MB whatever the input is.
    contents = []
    for path, name in ((first, FIRST_FILE), (second, SECOND_FILE)):
        with open(path or public_tokenizers.path(name), "rb") as file:
            contents.append(file.read())
    sent = spark.sparkContext.broadcast(tuple(contents))
    schema = _DOCS + (", groups string" if text else "")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(*sent.value)
        part, block, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _cut(texts, slice_bytes):
                some = texts[start:stop]
                made = align(some, known)
                held += sum(map(len, filter(None, some)))
                digests = [hashlib.sha256(g.as_py().encode()).hexdigest() if len(g.as_py()) else "" for g in made["groups"]]
                columns = [ids.slice(start, stop - start), *[made[c] for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string()),
                           pa.array(np.full(len(some), part + block)), made["pairs"], made["times"]]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times"]
                if text:
                    columns.append(made["groups"])
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)
                if held >= block_bytes:
                    block, held = block + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(blocks, schema)


@lru_cache(maxsize=1)
def read_sides(first: bytes, second: bytes) -> tuple[Side, Side]:
    """Both tokenizers from the contents of their files, once per worker."""
    a, b = byte_level(first), pieces(second)
    if len(b.contents) > 1 << _PAIR_BITS or len(a.contents) > 1 << (_CODE_BITS - _PAIR_BITS):
        raise ValueError("vocabularies too large for pairs of 31 bits")
    return a, b


@lru_cache(maxsize=1)
def remembered(first: bytes, second: bytes) -> Stretches:
    """What tasks of one worker have encoded."""
    return Stretches(*read_sides(first, second))


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n): documents of a batch that hold each pair."""
    for batch in batches:
        pairs = batch.column("pairs")
        flat = pa.table({"block": batch.column("block").take(pc.list_parent_indices(pairs)), "pair": pc.list_flatten(pairs)})
        counts = flat.group_by(["block", "pair"], use_threads=False).aggregate([([], "count_all")])
        yield from counts.select(["block", "pair", "count_all"]).rename_columns(["block", "pair", "n"]).to_batches()


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a block with n_best and count_sum, from the counts of the block's pairs."""
    pairs, times = docs["pairs"].combine_chunks(), docs["times"].combine_chunks()
    flat = pa.table({"doc": pc.list_parent_indices(pairs).cast(pa.int64()), "pair": pc.list_flatten(pairs), "times": pc.list_flatten(times)})
    # A block read in several batches has its counts as often.
    known = counts.group_by("pair", use_threads=False).aggregate([("count", "max"), ("best", "max")])
    met = flat.join(known, "pair", join_type="inner", use_threads=False)
    rows = pa.table({"doc": met["doc"], "n_best": pc.multiply(met["times"], met["best_max"].cast(pa.int64())),
                     "count_sum": pc.multiply(met["times"], met["count_max"])})
    sums = rows.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name in ("n_best", "count_sum"):
        full = np.zeros(len(docs), dtype=np.int64)
        full[sums["doc"].to_numpy()] = sums[f"{name}_sum"].to_numpy()
        out[name] = pa.array(full)
    return pa.table({**out, "groups_sha256": docs["groups_sha256"]})


def pair_counts(made: DataFrame) -> DataFrame:
    """(block, pair, n) of documents as ``aligned`` gives them."""
    ship(made.sparkSession)
    return made.select("block", "pairs").mapInArrow(_pairs_of_blocks, "block long, pair int, n long")


def scored(docs: DataFrame, **options) -> DataFrame:
    """Per document the size of its alignment and how its links stand in the whole table (eager: blocks and counts are stored)."""
    made = stored(aligned(docs, **options))
    blocks = stored(pair_counts(made))
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    first = F.shiftright("pair", _PAIR_BITS)
    top = counts.groupBy(first.alias("a")).agg(F.max("count").alias("top"))  # at most a row an id of the vocabulary
    known = counts.withColumn("a", first).join(F.broadcast(top), "a").select(
        "pair", "count", F.when(F.col("count") == F.col("top"), F.lit(1)).otherwise(F.lit(0)).alias("best"))
    back = blocks.select("block", "pair").join(known, "pair")
    return made.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = tables(spark, sf_dir, "documents")
    return scored(docs)

"""Prefix trie of conversations, subtree totals by time-forward processing.

A node is a distinct sequence of first turns.  It is named by its depth and the
exclusive or of 120-bit hashes of (position, role, text) of its turns, so the
names of all prefixes are running totals that can be cut into blocks: a
conversation of any length is shared by many tasks.

Totals travel from the leaves to the root.  Nodes are sorted externally in
reverse level order; each sends its totals to its parent through a priority
queue that writes what it cannot hold to the task's own unnamed scratch file,
and takes the totals sent to it from there.  This happens first within shards:

* The turns that the members of a node still have below it bound the size of
  its subtree.  Nodes over ``SHARD_TURNS`` are heavy, and so is the root; the
  subtree of a light node with a heavy parent is a shard, never larger than
  that, and never split.
* Totals of shard roots are added up for their parents, the heavy nodes.

and then across shard roots: nodes that share their smallest member form a
path.  Paths of heavy nodes are cut every ``PIECE`` levels; the pieces form a
tree, through which totals are passed the same way, and inside a piece they
are running sums.  A heavy path ends above more than ``SHARD_TURNS`` turns of
its own, so there are at most turns / ``SHARD_TURNS`` paths and twice that many
pieces and less: these alone go through a single task.

Hashes of conversations that end at a node are read as a stream sorted by
conversation, of which texts of at most ``CHUNK`` ids are made beforehand.

Cases: NULL turns come first; turns that tie are ordered by role, then text;
NULL role or text is empty; rows with a NULL conv_id belong to no conversation;
repeated rows are turns of their own; no row at all gives no node; a
conversation that is rebuilt without a turn is a member of the root alone; very
long texts and conversations are taken whole; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tables
from tidemark.llm.numbering import numbered
from tidemark.session import stored

FAMILY, HEADS = 20, 4  # conversations that share a first one, and how many of its turns at most, plus one
SHARD_TURNS = 100_000
PIECE = 100_000
QUEUED = 200_000  # totals a queue holds in memory
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
BLOCK_BITS = 16  # of positions, one running total
_DIGITS = 15
NODE = ["depth", "x", "y"]
_WORD = r"[^\x20\x09-\x0D]+"


# -- conversations -----------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, row, digest, words): turns numbered along (conv_id, turn, role, text); eager."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return numbered(rows, order, ["conv_id", digest, F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words")])[0]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation and (conv_id, pos, length, digest, words) of its rebuilt turns.

    Conversation c takes its first crc32(c) % HEADS turns from conversation
    c - c % FAMILY; of that one at most HEADS - 1 rows are ever looked up, by at
    most FAMILY conversations.
    """
    own = turns.groupBy("conv_id").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(own.select("*", first.alias("base"), heads).join(bases, "base", "left").select(
        "conv_id", "base", "start", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    placed = turns.join(convs, "conv_id").withColumn("p", F.col("row") - F.col("start") + 1)
    rest = placed.filter("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("pos"), "length", "digest", "words")
    shared = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("p") < HEADS)).select("base", "p", "digest", "words")
    front = convs.select("conv_id", "base", "h", "length").join(shared, "base").filter("p <= h").select(
        "conv_id", F.col("p").alias("pos"), "length", "digest", "words")
    return convs.select("conv_id", "length"), rest.unionByName(front)


def _lane(hexed: str, k: int) -> Column:
    return F.conv(F.substring(hexed, 1 + _DIGITS * k, _DIGITS), 16, 10).cast("long")


def prefixes(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Every prefix of every conversation: (conv_id, depth, length, words, x, y) and its parent's (px, py)."""
    hexed = turns.select("conv_id", "pos", "length", "words", F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256).alias("hexed"))
    terms = hexed.select("conv_id", "pos", "length", "words", _lane("hexed", 0).alias("tx"), _lane("hexed", 1).alias("ty"),
                         F.shiftright(F.col("pos") - 1, block_bits).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = terms.groupBy("conv_id", "block").agg(F.bit_xor("tx").alias("bx"), F.bit_xor("ty").alias("by"))
    carry = blocks.select("conv_id", "block", F.bit_xor("bx").over(earlier).alias("cx"), F.bit_xor("by").over(earlier).alias("cy")).filter("block > 0")
    run = terms.select("*", F.bit_xor("tx").over(inside).alias("wx"), F.bit_xor("ty").over(inside).alias("wy")).join(
        carry, ["conv_id", "block"], "left")
    x, y = (F.col(w).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for w, c in (("wx", "cx"), ("wy", "cy")))
    return run.select("conv_id", F.col("pos").cast("long").alias("depth"), "length", "words", x.alias("x"), y.alias("y"),
                      x.bitwiseXOR(F.col("tx")).alias("px"), y.bitwiseXOR(F.col("ty")).alias("py"))


# -- time-forward processing -------------------------------------------------

class SpillingQueue:
    """Priority queue of rows of five integers; what exceeds ``most`` goes to an unnamed scratch file in sorted runs."""

    ROW = struct.Struct("<5q")
    READ = 4096

    def __init__(self, most: int = QUEUED):
        self.most, self.near, self.file, self.end = max(2, most), [], None, 0
        self.runs: list[tuple[tuple[int, ...], int, Iterator]] = []  # heads of runs, itself a heap

    def push(self, row: tuple[int, ...]) -> None:
        heapq.heappush(self.near, row)
        if len(self.near) > self.most:
            self._spill()

    def _spill(self) -> None:
        """The rows due last go to a new run; a sorted list is a heap."""
        self.near.sort()
        far = self.near[self.most // 2:]
        del self.near[self.most // 2:]
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(b"".join(self.ROW.pack(*row) for row in far))
        run = self._read(self.end, len(far))
        self.end += len(far) * self.ROW.size
        heapq.heappush(self.runs, (next(run), self.end, run))

    def _read(self, at: int, n: int) -> Iterator[tuple[int, ...]]:
        while n:
            take = min(n, self.READ)
            self.file.seek(at)
            data = self.file.read(take * self.ROW.size)
            at, n = at + len(data), n - take
            yield from self.ROW.iter_unpack(data)

    def due(self, key: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Remove and yield the rows that begin with ``key``, which must come in sorted order."""
        size = len(key)
        while self.near and self.near[0][:size] == key:
            yield heapq.heappop(self.near)
        while self.runs and self.runs[0][0][:size] == key:
            row, name, run = self.runs[0]
            after = next(run, None)
            if after is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, name, run))
            yield row


def _forward(nodes: DataFrame, key: tuple[str, str, str], parent: tuple[str, str, str], queued: int) -> DataFrame:
    """Adds to ``leaves`` and ``saved`` of sorted nodes all they get from below, task by task.

    Rows come with ``key`` = (level, a, b) in descending level and then
    ascending (a, b); NULL in the first column of ``parent`` sends nothing.
    """
    ship(nodes.sparkSession)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = SpillingQueue(queued)
        for batch in batches:
            leaves, saved = batch["leaves"].tolist(), batch["saved"].tolist()
            up = batch[parent[0]].isna().tolist()
            columns = [batch[c].tolist() for c in key] + [batch[c].fillna(0).astype("int64").tolist() for c in parent]
            for i, (level, a, b, over, pa, pb) in enumerate(zip(*columns)):
                for row in queue.due((-level, a, b)):
                    leaves[i] += row[3]
                    saved[i] += row[4]
                if not up[i]:
                    queue.push((-over, pa, pb, leaves[i], saved[i]))
            yield batch.assign(leaves=leaves, saved=saved)

    return nodes.sortWithinPartitions(F.desc(key[0]), *key[1:]).mapInPandas(passed, nodes.schema)


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node, the root included: members, last words, parent's name and the turns below."""
    below = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("px").alias("px"),
        F.max("py").alias("py"), F.sum(F.col("length") - F.col("depth")).alias("below"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("below")).filter("n_convs > 0")
    return below.unionByName(root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("words"),
                                         none.alias("px"), none.alias("py"), "below"))


def _linked(nodes: DataFrame, shard_turns: int) -> DataFrame:
    """Adds n_children, parent_conv_id, heavy, and whether the parent is heavy.

    Children of the root meet its values as one row sent to all; a node with
    very many children is split by the skew join.
    """
    heavy = (F.col("depth") == 0) | (F.col("below") > shard_turns)
    counts = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(counts, NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), heavy.alias("heavy"))
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
                        F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("under_heavy"))
    deep = nodes.filter("depth > 1").join(over.filter("depth > 1"), ["depth", "px", "py"])
    first = nodes.filter("depth = 1").join(F.broadcast(over.filter("depth = 1")), ["depth", "px", "py"])  # the root alone
    top = nodes.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "under_heavy": F.lit(True)})
    columns = [*nodes.columns, "parent_conv_id", "under_heavy"]
    return deep.select(columns).unionByName(first.select(columns)).unionByName(top.select(columns))


def _shards(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """(conv_id, sx, sy): the name of the topmost light prefix of each conversation."""
    marked = rows.select("conv_id", *NODE).join(heavy.select(*NODE, F.lit(True).alias("heavy")), NODE, "left")
    return (marked.filter(F.col("heavy").isNull()).groupBy("conv_id")
            .agg(F.min_by(F.struct("x", "y"), "depth").alias("top")).select("conv_id", F.col("top.x").alias("sx"), F.col("top.y").alias("sy")))


def _across(heavy: DataFrame, piece: int, queued: int) -> DataFrame:
    """Totals of heavy nodes, whose ``leaves`` and ``saved`` hold their own and those of the shards below them."""
    named = stored(heavy.withColumn("band", F.floor(F.col("depth") / piece).cast("long")))
    pieces = named.groupBy("conv_id", "band").agg(
        F.min("depth").alias("level"), F.min_by("parent_conv_id", "depth").alias("over_conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = pieces.withColumn("over_band", F.floor((F.col("level") - 1) / piece).cast("long"))
    over = pieces.select(F.col("conv_id").alias("over_conv"), F.col("band").alias("over_band"), F.col("level").alias("over_level"))
    tree = pieces.join(over, ["over_conv", "over_band"], "left").select(
        "level", "conv_id", "band", "over_level", "over_conv", "over_band", "leaves", "saved")
    done = stored(_forward(tree.coalesce(1), ("level", "conv_id", "band"), ("over_level", "over_conv", "over_band"), queued))
    sent = done.filter("over_level IS NOT NULL").groupBy(F.col("over_conv").alias("conv_id"), (F.col("level") - 1).alias("depth")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    inside = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    full = named.join(sent, ["conv_id", "depth"], "left")
    own = [c for c in heavy.columns if c not in ("leaves", "saved")]
    return full.select(*own, *[F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).over(inside).alias(c) for c in ("leaves", "saved")])


def subtree_totals(rows: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = PIECE, queued: int = QUEUED) -> DataFrame:
    """Every node with parent, members, children, leaves and saved tokens (eager: nodes are stored)."""
    linked = stored(_linked(stored(_nodes(rows, convs)), shard_turns).select(
        "*", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    heavy, light = linked.filter("heavy"), linked.filter("NOT heavy")
    level = (F.col("depth") - 1).alias("over")
    inside = light.join(_shards(rows, heavy), "conv_id").withColumn("over", F.when(~F.col("under_heavy"), level))
    done = stored(_forward(inside.repartition("sx", "sy"), ("depth", "x", "y"), ("over", "px", "py"), queued))
    tops = done.filter("under_heavy").groupBy(level.alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    given = heavy.join(tops, NODE, "left").select(
        *[c for c in heavy.columns if c not in ("leaves", "saved")],
        *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return done.select(linked.columns).unionByName(_across(given, piece, queued).select(linked.columns))


# -- members that end at a node ----------------------------------------------

def end_digests(rows: DataFrame, convs: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end."""
    ship(rows.sparkSession)
    zero = F.lit(0).cast("long")
    ends = rows.filter("depth = length").select(*NODE, "conv_id").unionByName(
        convs.filter("length = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", chunk_bits).alias("chunk")).agg(ids.alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            found = []
            for *name, ids in zip(*[batch[c].tolist() for c in (*NODE, "ids")]):
                if name == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            yield pd.DataFrame(found, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInPandas(
        digests, "depth long, x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = PIECE, queued: int = QUEUED,
         block_bits: int = BLOCK_BITS, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row a node of the trie of rebuilt conversations (eager: turns, prefixes and nodes are stored)."""
    convs, turns = rebuilt(ordered_turns(conversations))
    rows = stored(prefixes(turns, block_bits))
    nodes = subtree_totals(rows, convs, shard_turns, piece, queued)
    return nodes.join(end_digests(rows, convs, chunk_bits), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, = tables(spark, sf_dir, "conversations")
    return trie(conversations)

"""Token counts kept up to date under edits.

A document's text is held as pre-tokens, and over their lengths and token counts
stands a segment tree of sums.  An edit finds the pre-tokens it touches by
descending the tree, re-splits the text from ``BEFORE`` pre-tokens ahead of it
until the new borders have met the old ones again, encodes only pre-tokens of
that stretch, and replaces the leaves; sums change along the paths above them.
The total is read at the root.  Counts are those of encoding the whole edited
text anew.

Leaves live in chunks of about ``CHUNK``; the tree stands over the chunks, so an
edit that changes the number of leaves rewrites one chunk and a path.

An edit is (start, length, replacement): from code point ``start``, ``length``
code points are replaced.  A start beyond the end appends, a length beyond the
end is cut there, negative numbers count as 0, NULL replacements as empty.

Cases: NULL and empty texts have no tokens and can be edited; NULL or no edits
leave the count; very long texts cost as much as the edit's surroundings and one
path; edits apply in their order; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import BYTE_FILE, Bpe, read_once, vocabulary
from tidemark.llm.common import ship, tables

CHUNK = 256
BEFORE = 3  # pre-tokens ahead of an edit whose borders it may move
MEET = 3  # borders in a row at which new and old splits agree again
_EDITS = "array<struct<start: bigint, length: bigint, replacement: string>>"


class SumTree:
    """Segment tree of pairs (characters, tokens) over a list of chunks."""

    def __init__(self, values: Sequence[tuple[int, int]]):
        self.size = 1
        while self.size < max(1, len(values)):
            self.size *= 2
        self.count = len(values)
        self.sums = [(0, 0)] * (2 * self.size)
        self.sums[self.size:self.size + len(values)] = list(values)
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    def set(self, at: int, value: tuple[int, int]) -> None:
        i = self.size + at
        self.sums[i] = value
        while i > 1:
            i //= 2
            self._add(i)

    def find(self, place: int) -> tuple[int, int]:
        """The chunk that holds character ``place`` (the last one, if beyond), and the characters before it."""
        i, before = 1, 0
        if place >= self.sums[1][0]:
            last = max(0, self.count - 1)
            return last, self.sums[1][0] - self.sums[self.size + last][0]
        while i < self.size:
            i *= 2
            if place >= before + self.sums[i][0]:
                before += self.sums[i][0]
                i += 1
        return i - self.size, before


class Counted:
    """A text with the token counts of its pre-tokens."""

    def __init__(self, text: str, bpe: Bpe):
        self.bpe = bpe
        self.encoded = 0  # characters encoded since
        pieces = [piece for _, piece in self._split(text, 0)] if bpe.cut and bpe.cut.search(text) else list(self._pieces(text, 0, len(text)))
        leaves = list(zip(pieces, map(bpe.sizes.__getitem__, pieces)))
        self.chunks = [leaves[i:i + CHUNK] for i in range(0, len(leaves), CHUNK)] or [[]]
        self._plant()

    def _plant(self) -> None:
        self.tree = SumTree([self._sum(c) for c in self.chunks])

    @staticmethod
    def _sum(chunk: list[tuple[str, int]]) -> tuple[int, int]:
        if not chunk:
            return 0, 0
        pieces, counts = zip(*chunk)
        return sum(map(len, pieces)), sum(counts)

    def _tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.bpe.sizes[piece]

    def _split(self, text: str, start: int) -> Iterator[tuple[int, str]]:
        """(end, pre-token) of ``text`` from ``start``, a border, on."""
        special = self.bpe.cut.search(text, start) if self.bpe.cut else None
        at = start
        while at < len(text):
            end = special.start() if special else len(text)
            for piece in self._pieces(text, at, end) if end > at else ():
                at += len(piece)
                yield at, piece
            if special:
                yield special.end(), special[0]
                at = special.end()
                special = self.bpe.cut.search(text, at)
            else:
                at = len(text)

    def _pieces(self, text: str, start: int, end: int) -> Iterator[str]:
        """Pre-tokens, which together are the text: byte-level vocabularies change and drop nothing."""
        part = text[start:end]
        return iter(self.bpe.split(part) if self.bpe.unsettled(part) else self.bpe.pieces.findall(part))

    @property
    def tokens(self) -> int:
        return self.tree.sums[1][1]

    @property
    def characters(self) -> int:
        return self.tree.sums[1][0]

    def text(self) -> str:
        return "".join(piece for chunk in self.chunks for piece, _ in chunk)

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(0, start), self.characters)
        stop = min(start + max(0, length), self.characters)
        chunk, before = self.tree.find(start)
        # From some pre-tokens ahead of the edit.
        place, leaf = before, 0
        for leaf, (piece, _) in enumerate(self.chunks[chunk]):
            if place + len(piece) > start:
                break
            place += len(piece)
        else:
            leaf = len(self.chunks[chunk])
        for _ in range(BEFORE):
            while leaf == 0 and chunk > 0:
                chunk -= 1
                leaf = len(self.chunks[chunk])
            if leaf == 0:
                break
            leaf -= 1
            place -= len(self.chunks[chunk][leaf][0])
        # The old leaves from there on, read as far as needed.
        last, reach = chunk, place
        old: list[tuple[str, int]] = []
        position = leaf
        wanted = 16

        def read(until: int) -> None:
            nonlocal last, position, reach
            while reach < until or len(old) < wanted:
                while last < len(self.chunks) and position >= len(self.chunks[last]):
                    last, position = last + 1, 0
                if last >= len(self.chunks):
                    return
                old.append(self.chunks[last][position])
                reach += len(old[-1][0])
                position += 1

        while True:
            read(stop)
            tail = "".join(piece for piece, _ in old)
            fresh = tail[: start - place] + replacement + tail[stop - place:]
            shift = len(replacement) - (stop - start)
            ends, at = {}, place
            for k, (piece, _) in enumerate(old):
                at += len(piece)
                ends[at] = k + 1
            final = last >= len(self.chunks) or (last == len(self.chunks) - 1 and position >= len(self.chunks[-1]))
            new, met, used, row = [], 0, None, []
            for end, piece in self._split(fresh, 0):
                if not final and end >= len(fresh) - 1:
                    break  # the last border read may move with what follows
                row.append(piece)
                where = place + end - shift
                if end >= start - place + len(replacement) and where in ends and where >= stop:
                    met += 1
                    if met == MEET:
                        new, used = row, ends[where]
                        break
                else:
                    met = 0
            else:
                if final:
                    new, used = row, len(old)
            if used is not None:
                break
            wanted *= 2
        counts = {piece: n for piece, n in old}
        leaves = [(piece, counts[piece] if piece in counts else self._tokens(piece)) for piece in new]
        self._replace(chunk, leaf, used, leaves)

    def _replace(self, chunk: int, leaf: int, used: int, leaves: list[tuple[str, int]]) -> None:
        first, rest = chunk, used
        kept = self.chunks[chunk][:leaf]
        at = leaf
        while True:
            here = len(self.chunks[chunk]) - at
            if rest <= here or chunk == len(self.chunks) - 1:
                tail = self.chunks[chunk][at + rest:]
                break
            rest -= here
            chunk, at = chunk + 1, 0
        merged = kept + leaves + tail
        if chunk == first and len(merged) <= 4 * CHUNK:
            self.chunks[first] = merged
            self.tree.set(first, self._sum(merged))
            return
        if len(merged) <= 4 * CHUNK * (chunk - first + 1):  # the same number of chunks, evened out
            span = chunk - first + 1
            share = -(-len(merged) // span) or 1
            for k in range(span):
                self.chunks[first + k] = merged[k * share:(k + 1) * share]
                self.tree.set(first + k, self._sum(self.chunks[first + k]))
            return
        self.chunks[first:chunk + 1] = [merged[i:i + CHUNK] for i in range(0, len(merged), CHUNK)]
        self._plant()


def counter(spark: SparkSession, path: str | None = None, name: str = BYTE_FILE):
    """Column function (text, edits): tokens before and after, and characters encoded for the edits."""
    ship(spark)
    content = vocabulary(spark, path, name)

    @F.pandas_udf("n_before long, n_after long, n_chars_after long, n_encoded long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bpe = read_once(content.value)
        for texts, edits in batches:
            out = []
            for text, changes in zip(texts, edits):
                counted = Counted(text or "", bpe)
                before, counted.encoded = counted.tokens, 0
                for change in changes if changes is not None else ():
                    if change is not None:
                        counted.edit(int(change["start"] or 0), int(change["length"] or 0), change["replacement"] or "")
                out.append((before, counted.tokens, counted.characters, counted.encoded))
                if len(bpe.sizes) > 600_000:
                    bpe.sizes.clear()
            yield pd.DataFrame(out, columns=["n_before", "n_after", "n_chars_after", "n_encoded"])

    return run


def counts_after(docs: DataFrame, edits: Column, **vocab: str) -> DataFrame:
    """doc_id with token counts of ``text`` before and after ``edits``, a column of edits in order."""
    made = docs.select("doc_id", counter(docs.sparkSession, **vocab)(F.col("text"), edits.cast(_EDITS)).alias("made"))
    return made.select("doc_id", "made.*")


def derived_edits(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Three edits of a document, from its own text and id: a deletion, a copy of its opening put elsewhere, an exchange."""
    size = F.greatest(F.lit(1), F.coalesce(F.length(text), F.lit(0)))

    def place(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(salt)), size)

    def edit(start: Column, length: Column, replacement: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), replacement.alias("replacement"))

    return F.array(edit(place(1), F.lit(17), F.lit("")), edit(place(2), F.lit(0), F.substring(text, 1, 40)),
                   edit(place(3), F.lit(9), F.upper(F.substring(text, 5, 12))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = tables(spark, sf_dir, "documents")
    return counts_after(docs, derived_edits())

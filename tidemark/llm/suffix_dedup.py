"""Removal of repeated passages, byte by byte, keeping the first copy.

A byte goes if some string of ``LENGTH`` bytes over it also starts in a
document with a smaller id.  Longest-previous-factor arrays tell that: in the
order of a suffix array, the previous and the next suffix of an earlier document
have the longest match with earlier text, and a passage whose match reaches
``LENGTH`` is a later copy.  A suffix array of everything would be one sort of
every byte, so the suffixes that cannot repeat are first put aside, exactly:

1. *Anchors.*  Each window of ``LENGTH`` bytes names its anchor, the gram of
   ``GRAM`` bytes in it with the least hash.  Equal windows have equal anchors.
   Windows that share an anchor place are consecutive and make a run.  Per shard
   of text the runs' hashes are packed and dealt by anchor: if the very same run
   is in an earlier document, all its windows are copies; if an anchor has
   different runs, those are checked on; anchors seen once are done.
2. *Suffixes.*  The bytes of the runs to check are dealt by anchor.  In each
   bucket the suffixes that begin a window are sorted by their bytes, and the
   longest-previous-factor array over that order settles the windows one by
   one.  Runs of an anchor with very many different runs (the edges of a passage
   that is everywhere) are dealt as single windows instead, by their own hash,
   after equal ones of a block of documents have been made one.
3. *Texts* meet the passages to remove, block by block.

An anchor or window never moves more than a few entries per shard or block,
however common it is, so a passage that a third of all documents share does not
load a task.  Everything travels as packed arrays with the documents' ids, in
buckets whose number follows the bytes of text.

Cases: NULL and empty texts have no bytes; texts shorter than ``LENGTH`` lose
nothing; rows with a NULL id are kept whole and are earlier than nothing; equal
ids are not smaller, so rows that repeat an id do not remove each other; long
texts are cut into overlapping pieces inside a task only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, ship, tables
from tidemark.session import stored

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # gram places in a window
BLOCK_BYTES = 6_000_000  # text in a block of documents, and about that much in each bucket
SHARD_BYTES = 8_000_000  # text whose runs are packed together
PIECE = 1 << 18  # window starts handled at once
SLICE = 1 << 17  # windows of split runs that leave at once
MANY = 16  # different runs of one anchor in one shard, beyond which they are all checked on, window by window, without being dealt
MANY_IN_ALL = 512  # the same for all shards together
_PLACE = np.uint64((1 << 21) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_DEALT, _COPY, _CHECK, _MARK, _SPLIT = range(5)  # states of runs


# ---- hashes of grams ---------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _doubled(x: np.ndarray, span: int) -> np.ndarray:
    """Hashes of grams twice as long."""
    return x[:-span] * _A + (x[span:] ^ (x[span:] >> np.uint64(31))) * _B


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of ``GRAM`` (16 + 4) and of 32 bytes."""
    one = data.astype(np.uint64) + np.uint64(1)
    two = _doubled(one, 1)
    four = _doubled(two, 2)
    eight = _doubled(four, 4)
    sixteen = _doubled(eight, 8)
    long = _mixed(_doubled(sixteen, 16))
    short = sixteen[: len(data) - GRAM + 1] * _A + (four[16: 16 + len(data) - GRAM + 1] ^ (four[16: 16 + len(data) - GRAM + 1] >> np.uint64(29))) * _C
    return _mixed(short), long


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor hash, run hash) of the runs of windows at the starts marked in ``window``."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    short, long = gram_hashes(data)
    keyed = (short & ~_PLACE) | np.arange(len(short), dtype=np.uint64)  # of equal hashes, the leftmost place
    place = (window_minima(keyed, SPAN) & _PLACE).astype(np.int64)
    good = window[: len(place)]
    begins = np.flatnonzero(good & np.concatenate([[True], (place[1:] != place[:-1]) | ~good[:-1]]))
    ends = np.flatnonzero(good & np.concatenate([(place[1:] != place[:-1]) | ~good[1:], [True]]))
    size = ends - begins
    # Three overlapping grams of 32 bytes cover a run of at most 80.
    run = _mixed(long[begins] * _A + long[begins + 18] * _B + long[ends + 18] * _C + size.astype(np.uint64))
    return begins, ends, short[place[begins]], run


def pieces_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, which starts are windows, document of each byte, offset in the document) of bounded stretches of texts.

    Short texts are laid end to end; a long one comes in stretches that
    overlap, each window being in one of them.
    """
    parts, size = [], 0

    def laid(parts: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(x for _, _, x in parts), dtype=np.uint8)
        lengths = np.array([len(x) for _, _, x in parts])
        first = np.cumsum(lengths) - lengths
        within = np.arange(len(data)) - np.repeat(first, lengths)
        window = within + LENGTH <= np.repeat(lengths, lengths)
        return data, window, np.repeat(np.array([k for k, _, _ in parts]), lengths), within + np.repeat(np.array([o for _, o, _ in parts]), lengths)

    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for start in range(0, len(text) - LENGTH + 1, PIECE):
            stretch = text[start:start + PIECE + LENGTH - 1]
            if parts and size + len(stretch) > PIECE:
                yield laid(parts)
                parts, size = [], 0
            parts.append((k, start, stretch))
            size += len(stretch)
    if parts:
        yield laid(parts)


# ---- packed arrays -----------------------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal rank stand together."""
    out = [np.array([len(arrays)], dtype=np.int64).tobytes()]
    for array in arrays:
        array = np.ascontiguousarray(array)
        planes = array.view(np.uint8).reshape(len(array), array.dtype.itemsize).T
        out += [array.dtype.str.encode().ljust(8), np.array([len(array)], dtype=np.int64).tobytes(), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(out))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    count, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(count):
        kind, size = np.dtype(raw[at:at + 8].decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 16).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += 16 + size * kind.itemsize
    return out


def _narrow(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The low ``width`` bytes of 64-bit hashes, as columns."""
    return [(x >> np.uint64(8 * i)).astype(np.uint8) for i in range(width)]


def _wide(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for i, column in enumerate(columns):
        out |= column.astype(np.uint64) << np.uint64(8 * i)
    return out


def _dealt(bucket: np.ndarray, ids: np.ndarray, kinds: np.ndarray, first: np.ndarray, columns: list[np.ndarray],
           data: np.ndarray | None = None, size: np.ndarray | None = None) -> pd.DataFrame:
    """Rows (bucket, packed entries); a document's key stands once for its entries in a bucket.

    ``data`` holds ``size`` bytes for each entry, end to end.
    """
    order = np.lexsort((first, kinds, ids, bucket))
    bucket, ids, kinds, first = bucket[order], ids[order], kinds[order], first[order].astype(np.int32)
    columns = [c[order] for c in columns]
    ends = np.append(np.flatnonzero(_firsts(bucket))[1:], len(bucket)) if len(bucket) else np.zeros(0, dtype=np.int64)
    if data is not None:
        start = (np.cumsum(size) - size)[order]
        size = size[order]
    out, a = [], 0
    for b in ends.tolist():
        new = np.flatnonzero(_firsts(ids[a:b], kinds[a:b]))
        count = np.diff(np.append(new, b - a))
        own = [np.diff(ids[a:b][new], prepend=0), kinds[a:b][new].astype(np.uint32), count.astype(np.uint32), first[a:b], *(c[a:b] for c in columns)]
        if data is not None:
            own.append(data[_stretches(start[a:b], size[a:b])])
        out.append((int(bucket[a]), pack(*own)))
        a = b
    return pd.DataFrame(out, columns=["bucket", "packed"])


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of stretches of ``size`` from each ``start``, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _entries(values: pd.Series) -> list[np.ndarray]:
    """ids, kinds, first and the further columns of packed entries."""
    parts = []
    for value in values:
        ids, kinds, count, *columns = unpack(value)
        parts.append([np.repeat(np.cumsum(ids), count), np.repeat(kinds, count), *columns])
    return [np.concatenate(x) for x in zip(*parts)]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal entries (columns are sorted)."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64) * _A + _B) % np.uint64(blocks)).astype(np.int64)


# ---- suffix arrays -----------------------------------------------------------------------------------------------

def suffix_array(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``data`` at ``places`` by their first ``depth`` bytes, and their ranks (equal prefixes, equal rank).

    Eight bytes are compared at a time; every suffix has at least ``depth`` bytes.
    """
    if not len(places):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) + 1, dtype=np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | wide[i:i + len(word)]
    steps = [min(i, max(0, depth - 8)) for i in range(0, depth, 8)]
    mask = np.uint64((1 << 64) - 1 if depth >= 8 else ((1 << 8 * depth) - 1) << 8 * (8 - depth))
    keys = [word[places + i] & mask for i in steps]
    order = np.lexsort(keys[::-1])
    rank = np.empty(len(places), dtype=np.int64)
    rank[order] = np.cumsum(_firsts(*(k[order] for k in keys)))
    return order, rank


def previous_factors(order: np.ndarray, rank: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether each place of ``order`` has, among suffixes of equal rank, one of an earlier document.

    The previous and the next suffix in suffix order with a smaller document
    number are the closest earlier matches; both lie within the run of equal
    rank exactly if the match reaches the depth of the ranks.
    """
    docs, group = document[order], rank[order]
    found = np.zeros(len(order), dtype=bool)
    new = _firsts(group)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    for ahead in (True, False):  # smaller before, then smaller after
        d = docs if ahead else docs[::-1]
        g = np.repeat(np.arange(len(starts)), sizes)
        g = g if ahead else (len(starts) - 1 - g)[::-1]
        # Running minimum of documents within a group: groups are told apart by an offset that falls.
        top = int(docs.max(initial=0)) + 1
        running = np.minimum.accumulate(d + (len(starts) - g) * top) - (len(starts) - g) * top
        before = np.concatenate([[top], running[:-1]])
        smaller = (before < d) & ~_firsts(g)
        found |= smaller if ahead else smaller[::-1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = found
    return out


# ---- stage 1: runs -----------------------------------------------------------------------------------------------

def _shard_entries(ids: np.ndarray, kinds: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """Entries (state, anchor, run, id, kind, first window, further windows) of one shard."""
    found = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    parts = []
    for data, window, document, offset in pieces_of(texts):
        begins, ends, anchor, run = runs_of(data, window)
        parts.append([anchor, run, document[begins], offset[begins], ends - begins])
    anchor, run, document, first, more = (np.concatenate(x) for x in zip(found, *parts))
    owner = ids[document]
    order = np.lexsort((owner, run, anchor))
    anchor, run, document, owner, first, more = (x[order] for x in (anchor, run, document, owner, first, more))
    new_anchor, new_run = _firsts(anchor), _firsts(anchor, run)
    of_run = np.cumsum(new_run) - 1
    least = owner[np.flatnonzero(new_run)][of_run] if len(owner) else owner
    state = np.where(owner > least, _COPY, _DEALT).astype(np.uint8)
    of_anchor = np.cumsum(new_anchor) - 1
    many = (np.bincount(of_anchor, weights=new_run) > MANY)[of_anchor] if len(anchor) else np.zeros(0, dtype=bool)
    state[many & (state == _DEALT)] = _SPLIT
    # An anchor whose runs are checked on anyway leaves one mark, so that its runs elsewhere are treated alike.
    mark = np.flatnonzero(many & new_anchor)
    columns = [state, anchor, run, owner, kinds[document], first, more]
    marks = [np.full(len(mark), _MARK, dtype=np.uint8), *(c[mark] for c in columns[1:])]
    return [np.concatenate(x) for x in zip(columns, marks)]


def _runs_dealt(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        ids, kinds, texts, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            state, anchor, run, owner, kind, first, more = _shard_entries(
                np.array(ids, dtype=np.int64), np.array(kinds, dtype=np.int64), texts)
            told = (state == _COPY) | (state == _SPLIT)  # settled here: their hashes need not travel
            anchor_told = np.where(told, np.uint64(0), anchor >> np.uint64(24))
            return _dealt((anchor % np.uint64(buckets)).astype(np.int64), owner, kind, first, [
                state, *_narrow(anchor_told, 4), *_narrow(np.where(told, np.uint64(0), run), 6), more.astype(np.uint8)])

        for batch in batches:
            for i, h, text in zip(batch["id"], batch["kind"], batch["text"]):
                ids.append(i)
                kinds.append(h)
                texts.append(text.encode("utf-8"))
                size += len(texts[-1])
                if size >= SHARD_BYTES:
                    yield flush()
                    ids, kinds, texts, size = [], [], [], 0
        if texts:
            yield flush()

    return run


def _runs_settled(blocks: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        ids, kinds, first, state, *hashes, more = _entries(group.pop("packed"))
        state, anchor, run_hash = state.copy(), _wide(hashes[:4]), _wide(hashes[4:])
        open_ = np.flatnonzero((state == _DEALT) | (state == _MARK))
        order = open_[np.lexsort((ids[open_], run_hash[open_], anchor[open_]))]
        a, r, i, s = anchor[order], run_hash[order], ids[order], state[order]
        if len(order):
            new_anchor, new_run = _firsts(a), _firsts(a, r)
            of_anchor, of_run = np.cumsum(new_anchor) - 1, np.cumsum(new_run) - 1
            runs = np.bincount(of_anchor, weights=new_run)
            split = (np.bincount(of_anchor, weights=s == _MARK) > 0) | (runs > MANY_IN_ALL)
            least = np.full(of_run[-1] + 1, np.iinfo(np.int64).max)
            dealt = s == _DEALT
            np.minimum.at(least, of_run[dealt], i[dealt])
            onward = np.where(split, _SPLIT, np.where(runs > 1, _CHECK, _DEALT))
            state[order] = np.where(dealt, np.where(i > least[of_run], _COPY, onward[of_anchor]), _MARK)
        keep = (state == _COPY) | (state == _CHECK) | (state == _SPLIT)
        return _dealt(block_of(ids[keep], blocks), ids[keep], kinds[keep], first[keep], [state[keep], more[keep]])

    return run


# ---- stage 2: suffixes -------------------------------------------------------------------------------------------

def _blocked(blocks: int):
    """Texts packed by block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode("utf-8") for t in batch["text"]]
            ids, size = batch["id"].to_numpy(np.int64), np.array([len(t) for t in texts], dtype=np.int64)
            yield _dealt(block_of(ids, blocks), ids, batch["kind"].to_numpy(np.int64), np.arange(len(ids)), [size],
                         np.frombuffer(b"".join(texts), dtype=np.uint8), size)

    return run


def _texts_of(values: pd.Series) -> dict[tuple[int, int], bytes]:
    """Texts of a block by id and kind."""
    out = {}
    for value in values:
        ids, kinds, count, _, size, data = unpack(value)
        raw, at = data.tobytes(), 0
        del data
        for i, k, n in zip(np.repeat(np.cumsum(ids), count).tolist(), np.repeat(kinds, count).tolist(), size.tolist()):
            out[i, k] = raw[at:at + n]
            at += n
    return out


def _laid_out(own: dict[tuple[int, int], bytes], ids: np.ndarray, kinds: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches of texts, end to end."""
    return np.frombuffer(b"".join(own[i, k][f:f + n] for i, k, f, n in zip(ids.tolist(), kinds.tolist(), first.tolist(), size.tolist())), dtype=np.uint8)


def _cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring entries of together about ``most`` bytes."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _least_anchors(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The anchor of each run of ``size`` bytes, from its first window; hashes are made for a stretch of runs at a time."""
    start, out = np.cumsum(size) - size, []
    for a, b in _cuts(size, PIECE):
        part = data[start[a]:start[b - 1] + size[b - 1]]
        keyed, own = gram_hashes(part)[0] & ~_PLACE, start[a:b] - start[a]
        borders = np.stack([own, own + SPAN], axis=1).ravel()[: 2 * len(own) - (own[-1] + SPAN >= len(keyed))]
        out.append(np.minimum.reduceat(keyed, borders)[::2])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _suffixes_dealt(buckets: int):
    """The bytes of the runs to check, dealt by anchor, or by window where an anchor has very many runs.

    Windows leave in slices, so what a task holds beside the runs' own bytes
    does not grow with their number.
    """
    nothing = pd.DataFrame({"bucket": [], "packed": []})

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(answers) or not len(texts):
            return nothing
        give_back()
        ids, kinds, first, state, more = _entries(answers.pop("packed"))
        check = np.flatnonzero((state == _CHECK) | (state == _SPLIT))
        if not len(check):
            return nothing
        ids, kinds, first, split, more = (x[check] for x in (ids, kinds, first, state == _SPLIT, more.astype(np.int64)))
        own = _texts_of(texts.pop("packed"))
        parts = []
        if not split.all():
            i, k, f, m = (x[~split] for x in (ids, kinds, first, more))
            data = _laid_out(own, i, k, f, m + LENGTH)
            bucket = ((_least_anchors(data, m + LENGTH) >> np.uint64(21)) % np.uint64(buckets)).astype(np.int64)
            parts.append(_dealt(bucket, i, k, f, [np.zeros(len(i), dtype=np.uint8), m.astype(np.uint8)], data, m + LENGTH))
        if split.any():
            i, k, f, m = (x[split] for x in (ids, kinds, first, more))
            data = _laid_out(own, i, k, f, m + LENGTH)
            start = np.cumsum(m + LENGTH) - (m + LENGTH)
            del own
            windows = _stretches(start, m + 1)
            run_of = np.repeat(np.arange(len(i)), m + 1)
            order, rank = suffix_array(data, windows, LENGTH)
            copied = previous_factors(order, rank, np.unique(i[run_of], return_inverse=True)[1])
            del order, rank
            # Later copies within the block are settled; the first ones are asked about elsewhere.
            for a in range(0, len(windows), SLICE):
                at, of, told = windows[a:a + SLICE], run_of[a:a + SLICE], copied[a:a + SLICE]
                long = gram_hashes(data[at[0]:at[-1] + LENGTH])[1]
                bucket = (_mixed(long[at - at[0]] * _A + long[at - at[0] + 18]) % np.uint64(buckets)).astype(np.int64)
                width = np.where(told, 0, LENGTH)
                parts.append(_dealt(bucket, i[of], k[of], f[of] + at - start[of], [told.astype(np.uint8), np.zeros(len(at), dtype=np.uint8)],
                                    data[_stretches(at[~told], width[~told])], width))
        return pd.concat(parts)

    return run


def _suffixes_settled(blocks: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        ids, kinds, first, copied, more, data = _entries(group.pop("packed"))
        asked = np.flatnonzero(copied == 0)
        count = more[asked].astype(np.int64) + 1
        start = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        windows = _stretches(start, count)
        of = np.repeat(asked, count)
        order, rank = suffix_array(data, windows, LENGTH)
        earlier = previous_factors(order, rank, np.unique(ids[of], return_inverse=True)[1] if len(of) else of)
        # Copied windows that stand together in a run travel as one stretch.
        within = windows - np.repeat(start, count)
        begins = np.flatnonzero(earlier & ~(np.concatenate([[False], earlier[:-1]]) & (within > 0))) if len(of) else of
        ends = np.flatnonzero(earlier & ~(np.concatenate([earlier[1:], [False]]) & np.concatenate([within[1:] > 0, [False]]))) if len(of) else of
        known = np.flatnonzero(copied == 1)
        who = np.concatenate([of[begins], known])
        at = np.concatenate([first[of[begins]] + within[begins], first[known]])
        further = np.concatenate([ends - begins, np.zeros(len(known), dtype=np.int64)]).astype(np.uint8)
        return _dealt(block_of(ids[who], blocks), ids[who], kinds[who], at, [np.full(len(who), _COPY, dtype=np.uint8), further])

    return run


# ---- stage 3: texts ----------------------------------------------------------------------------------------------

def removed_mask(size: int, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Bytes covered by the windows that start at ``first`` and the ``more`` places after it."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + more.astype(np.int64) + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


def _whole_letters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` narrowed to letters of which every byte goes, so that what is left is text."""
    head = (data & 0xC0) != 0x80
    letter = np.cumsum(head) - 1
    return np.bincount(letter, weights=~gone)[letter] == 0 if len(data) else gone


def _texts_finished(text_too: bool):
    names = ["id", "kind", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text_too

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        give_back()
        rows = []
        own = _texts_of(texts.pop("packed")) if len(texts) else {}
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if len(answers):
            ids, kinds, first, state, more = _entries(answers.pop("packed"))
            keep = np.flatnonzero(state == _COPY)
            order = keep[np.lexsort((kinds[keep], ids[keep]))]
            ids, kinds, first, more = ids[order], kinds[order], first[order].astype(np.int64), more[order]
            cuts = np.flatnonzero(_firsts(ids, kinds)) if len(ids) else np.zeros(0, dtype=np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
                found[int(ids[a]), int(kinds[a])] = (first[a:b], more[a:b])
        for (i, h), raw in own.items():
            if (i, h) in found:
                data = np.frombuffer(raw, dtype=np.uint8)
                gone = removed_mask(len(data), *found[i, h])
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                left = data[~gone].tobytes()
                row = [i, h, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()]
                if text_too:
                    row.append(data[~_whole_letters(data, gone)].tobytes().decode("utf-8"))
            else:
                row = [i, h, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()] + [raw.decode("utf-8")] * text_too
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    return run


def _kind(text: Column) -> Column:
    """24 bits of a text's hash, to tell rows of one id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 24) - 1))


def removals(docs: DataFrame, text_too: bool = False) -> DataFrame:
    """(id, kind, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every distinct text of a non-NULL id.

    Eager up to the settled runs, which are written to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).filter("id IS NOT NULL").select(
        "id", _kind(F.col("text")).alias("kind"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(8, -(-size // BLOCK_BYTES))
    row = "bucket long, packed binary"
    settled = stored(texts.mapInPandas(_runs_dealt(parts), row).groupBy("bucket").applyInPandas(_runs_settled(parts), row))
    blocked = texts.mapInPandas(_blocked(parts), row)
    suffixes = blocked.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInPandas(_suffixes_dealt(parts), row)
    more = suffixes.groupBy("bucket").applyInPandas(_suffixes_settled(parts), row)
    answers = settled.union(more).groupBy("bucket")
    out = "id long, kind long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * text_too
    return blocked.groupBy("bucket").cogroup(answers).applyInPandas(_texts_finished(text_too), out)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _kind(text).alias("kind"), F.octet_length(text).cast("long").alias("size"),
                       F.when(F.col("doc_id").isNull(), F.sha2(text, 256)).alias("whole"))
    found = removals(docs)
    none = F.lit(0).cast("long")
    return rows.join(found, (rows["doc_id"] == found["id"]) & (rows["kind"] == found["kind"]), "left").select(
        "doc_id", F.coalesce("n_bytes", "size").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut from ``text`` (letters whole) and ``n_chars`` put right."""
    found = removals(docs, text_too=True).filter("n_removed > 0").select(
        F.col("id").alias("_own_id"), F.col("kind").alias("_own_kind"), F.col("kept").alias("_own_kept"))
    joined = docs.join(found, (docs["doc_id"] == found["_own_id"]) & (_kind(docs["text"]) == found["_own_kind"]), "left")
    changed = {"text": F.coalesce(found["_own_kept"], docs["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found["_own_kept"].isNull(), docs["n_chars"]).otherwise(F.length("_own_kept").cast("long"))
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(*tables(spark, sf_dir, "documents"))

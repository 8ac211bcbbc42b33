"""Approximate nearest neighbours by cross-polytope hashing.

Each table applies pseudo-rotations, three rounds of random signs and a fast
Hadamard transform, and assigns a unit vector to its nearest signed axis;
``functions`` such axes name a bucket.  A query probes the buckets whose axes are
nearest (``PROBES`` per function), and all vectors found there are ranked by
their exact inner product in double precision.

The largest inner products are wanted among vectors of different lengths.
Vectors are therefore split into bands of similar length (powers of ``BAND``);
every band has buckets of its own on the unit sphere, and every query probes all bands,
so the order within a band is that of the angles but for a factor of ``BAND``.

Bands of at most ``SCANNED`` vectors are not hashed: every query is ranked against
all of them, in parts of vectors and blocks of queries.  So is every query for which
the buckets gave fewer vectors than asked for, against the whole table.

Equal vectors are made one first (a vector answers with its smallest ids, more
than a result can hold are never needed), so copies cost nothing.  Buckets that
differ in the axis of the first function only are a cell.  A query goes to a cell
once, with the axes it probes there.  Cells are dealt in parts of about ``PART``
vectors by a hash and their queries in blocks of ``VISITS``; queries visit every
part, so no bucket is capped and none is a single task.  The number of functions of a band follows
its number of vectors (``per_bucket`` of them in a bucket), and the number of
tables follows the functions.

Cases: vectors that are NULL, empty, zero or hold NULL or non-finite numbers,
and rows with a NULL id, take no part; shorter vectors count as padded with
zeros; a query's own id is never its answer, also where rows repeat it; an id
that repeats is reported once, with its best score; ties go to the smaller id;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tables
from tidemark.session import stored

NEAREST = 20
TABLES, PROBES, PER_BUCKET = 6, 24, 400
PART, SCANNED = 4_000, 4_000
BLOCK = 2_000  # queries ranked against a part at once
VISITS = 8_000  # of them, where they meet only their buckets of it
CHUNK = 50_000  # rows that a task hashes at once
BAND = 1.2
ROUNDS, SEED = 3, 20_11
_ROUNDING = 1e-10  # by which, as a share of both lengths, a rough score may be off


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x`` (a power of two columns), scaled to keep lengths."""
    rows, width = x.shape
    out, half = x.copy(), 1
    while half < width:
        out = out.reshape(rows, -1, 2, half)
        out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return out / math.sqrt(width)


def signs(table: int, function: int, width: int) -> np.ndarray:
    """The signs of the pseudo-rotation of one function: fixed by the seed and its place."""
    return np.random.default_rng((SEED, table, function, width)).choice((-1.0, 1.0), (ROUNDS, width))


def rotated(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    for turn in turns:
        x = hadamard(x * turn)
    return x


def padded(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of the unit sphere: vectors padded with zeros and brought to length 1."""
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    out /= np.abs(out).max(axis=1)[:, None]  # squares of very large or small numbers stay finite
    return out / np.linalg.norm(out, axis=1)[:, None]


def axes_of(z: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest signed axes of each row, nearest first."""
    both = np.concatenate([z, -z], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(most, both.shape[1])]


def cells_of(best: list[np.ndarray], base: int, rows: int) -> np.ndarray:
    """Cells of each row: all combinations of its axes of the functions after the first; one cell if there are none."""
    out = [sum((axes[:, pick] * base**f for f, (axes, pick) in enumerate(zip(best, picks))), np.zeros(rows, dtype=np.int64))
           for picks in itertools.product(*(range(axes.shape[1]) for axes in best))]
    return np.stack(out, axis=1)


def _hashed(counts: dict[int, int], width: int, probes: int | None, bare: bool = False):
    """Rows (functions, band, t, cell, lows, id, vector): each vector in its cell, or each query in those it probes.

    A bucket is a cell and an axis of the first function, so a query is sent to
    a cell once, with its axes there (``lows``), however many buckets it probes.
    ``counts`` has the number of tables by number of functions.  A vector has the
    functions of its band; a query is hashed once for each number of them.
    ``bare`` rows end with the cell, to be counted.
    """
    turns = {functions: [[signs(t, f, width) for f in range(functions)] for t in range(count)] for functions, count in counts.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for functions in counts:
                mine = batch if probes else batch[batch["functions"] == functions]
                step = max(1, min(2_000, CHUNK // min(probes or 1, 2 * width) ** (functions - 1)))
                for rows in (mine.iloc[at:at + step] for at in range(0, len(mine), step)):
                    unit = padded(rows["vector"], width)
                    for t, table in enumerate(turns[functions]):
                        best = [axes_of(rotated(unit, turn), probes or 1) for turn in table]
                        cells = cells_of(best[1:], 2 * width, len(rows))
                        visits = cells.shape[1]
                        out = {"functions": np.full(len(rows) * visits, functions, dtype=np.int32),
                               "band": np.repeat(rows["band"].to_numpy(dtype=np.int32), visits),
                               "t": np.full(len(rows) * visits, t, dtype=np.int32), "cell": cells.ravel()}
                        if not bare:
                            lows = [x.tobytes() for x in best[0].astype(np.int32)]
                            out |= {"lows": [x for x in lows for _ in range(visits)], "id": np.repeat(rows["id"].to_numpy(), visits),
                                    "vector": [x for x in rows["vector"] for _ in range(visits)]}
                        yield pd.DataFrame(out)

    return run


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:most]


def _ranked(most: int):
    """The best of ``vectors`` for each query: of all of them, or where they have ``lows`` of those that share one with it."""
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            width = max(queries["vector"].map(len).max(), vectors["vector"].map(len).max())

            def matrix(rows: pd.Series) -> np.ndarray:
                m = np.zeros((len(rows), width))
                for i, x in enumerate(rows):
                    m[i, : len(x)] = x
                return m

            probed = "lows" in vectors
            if probed:
                low = np.frombuffer(b"".join(vectors["lows"]), dtype=np.int32)
                order = np.argsort(low, kind="stable")
                vectors, low = vectors.iloc[order], low[order]
                own, starts = np.unique(low, return_index=True)
                places = np.searchsorted(own, low)
            c, ids = matrix(vectors["vector"]), vectors["id"].to_numpy()
            longest = np.sqrt((c * c).sum(axis=1)).max()
            for at in range(0, len(queries), 500):
                rows = queries.iloc[at:at + 500]
                q = matrix(rows["vector"])
                margin = _ROUNDING * np.sqrt((q * q).sum(axis=1)) * longest
                if probed:
                    axes = np.stack([np.frombuffer(x, dtype=np.int32) for x in rows["lows"]])
                    met = (axes[:, :, None] == own).any(axis=1)
                    rough = np.empty((len(q), len(ids)))
                    for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        mine = np.flatnonzero(met[:, k])
                        rough[mine, start:end] = q[mine] @ c[start:end].T
                    seen = [np.flatnonzero(x) for x in met[:, places]]
                else:
                    rough = q @ c.T
                    seen = [np.arange(len(ids))] * len(q)
                for k, (query, mine) in enumerate(zip(rows["id"], seen)):
                    if len(mine):
                        # All that may tie with the last place, whatever the order of a rough sum did to them.
                        scores, last = rough[k, mine], max(0, len(mine) - most)
                        near = mine[scores >= np.partition(scores, last)[last] - margin[k]]
                        exact = (q[k] * c[near]).sum(axis=1)  # the same sum wherever the vector stands
                        best = _best(ids[near], exact, most)
                        out.append((query, ids[near][best], exact[best]))
        return pd.DataFrame(out, columns=["query", "ids", "scores"])

    return run


def _merged(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(list(group["ids"])), np.concatenate(list(group["scores"]))
        ids, first = np.unique(ids, return_index=True)
        best = _best(ids, scores[first], most)
        return pd.DataFrame({"query": group["query"].iloc[0], "id": ids[best], "score": scores[first][best]})

    return run


_LISTS = "query long, ids array<long>, scores array<double>"


def _scanned(vectors: DataFrame, n: int, wanted: DataFrame, asked: int, most: int) -> DataFrame:
    """The best of all ``vectors`` (id, vector; ``n`` of them) for each of the ``asked`` queries, a list for each part."""
    parts, blocks = max(1, -(-n // PART)), max(1, -(-asked // BLOCK))

    def dealt(column: str, count: int):
        return F.pmod(F.xxhash64(column, F.lit(7)), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = wanted.select(each(parts).alias("part"), dealt("query", blocks).alias("block"), F.col("query").alias("id"), "vector")
    right = vectors.select(dealt("id", parts).alias("part"), each(blocks).alias("block"), "id", "vector")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_ranked(most), _LISTS)


def _probed(vectors: DataFrame, counts: dict[int, int], width: int, wanted: DataFrame, probes: int, most: int) -> DataFrame:
    """The best of the ``vectors`` (id, vector, band, functions) in the buckets each query probes, a list for each part of a cell.

    Cells are counted first, on both sides, and dealt in parts of vectors and
    blocks of queries; a row a cell, of some thousand vectors, is broadcast.
    """
    place = ["functions", "t", "cell"]
    queries = wanted.select(F.col("query").alias("id"), "vector", F.lit(0).alias("band"))

    def hashed(rows: DataFrame, asked: int | None, bare: bool) -> DataFrame:
        kind = "functions int, band int, t int, cell long"
        return rows.mapInPandas(_hashed(counts, width, asked, bare), kind if bare else
                                f"{kind}, lows binary, id long, vector {vectors.schema['vector'].dataType.simpleString()}")

    def share(most: int) -> Column:
        return F.ceil(F.count(F.lit(1)) / most).cast("int")

    def dealt(count: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    parts = stored(hashed(vectors, None, True).groupBy("band", *place).agg(share(PART).alias("parts")))
    blocks = F.broadcast(stored(hashed(queries, probes, True).groupBy(*place).agg(share(VISITS).alias("blocks"))))
    index = (hashed(vectors, None, False).join(F.broadcast(parts), ["band", *place]).join(blocks, place)
             .withColumn("part", dealt("parts", 7)).withColumn("block", each("blocks")))
    visits = (hashed(queries, probes, False).drop("band").join(F.broadcast(parts), place).join(blocks, place)
              .withColumn("block", dealt("blocks", 11)).withColumn("part", each("parts")))
    key = ["band", *place, "part", "block"]
    return visits.select(*key, "lows", "id", "vector").groupBy(*key).cogroup(
        index.select(*key, "lows", "id", "vector").groupBy(*key)).applyInPandas(_ranked(most), _LISTS)


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables_: int = TABLES, probes: int = PROBES,
           per_bucket: int = PER_BUCKET, scanned: int = SCANNED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the nearest vectors other than its own id.

    Both frames have vec_id and embedding.  Eager: small aggregates (one row a
    band), and the hashed vectors and what was found are written to the shared folder.
    """
    ship(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))

    most = nearest + 1
    rows, asked = usable(vectors), usable(queries)
    # The smallest ids of each distinct vector; Spark applies the rank limit before it shuffles, too.
    ranked = rows.selectExpr("id", "vector", "row_number() OVER (PARTITION BY vector ORDER BY id) AS place").filter(f"place <= {most}")
    widest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("widest")) * (x / F.col("widest")))
    distinct = stored(ranked.groupBy("vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")).withColumn("widest", widest)
                      .withColumn("band", F.round((F.log("widest") + F.log(squares) / 2) / math.log(BAND)).cast("int")).drop("widest"))
    wanted = asked.groupBy("vector").agg(F.min("id").alias("query"))
    bands = distinct.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).collect()
    shape = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    width = 1 << max(1, (max([shape["size"] or 1, *(b["size"] for b in bands)]) - 1).bit_length())
    hashed = {b["band"]: max(1, round(math.log(b["n"] / per_bucket, 2 * width))) for b in bands if b["n"] > scanned}
    few = sum(b["n"] for b in bands if b["band"] not in hashed)
    points = distinct.select(F.col("rep").alias("id"), "vector", "band")
    lists = []
    if few or not bands:
        lists.append(_scanned(points.filter(~F.col("band").isin(list(hashed))), few, wanted, shape["n"], most))
    if hashed:
        functions = F.element_at(F.create_map(*[F.lit(x) for pair in hashed.items() for x in pair]), F.col("band"))
        counts = {f: tables_ * 3 ** (f - 1) for f in sorted(set(hashed.values()))}
        lists.append(_probed(points.filter(F.col("band").isin(list(hashed))).withColumn("functions", functions), counts, width, wanted, probes, most))

    def named(lists: DataFrame) -> DataFrame:
        """Distinct vectors become ids again; at most ``most`` times ``most`` of them stand by a query."""
        best = lists.groupBy("query").applyInPandas(_merged(most), "query long, id long, score double")
        return (best.join(distinct.select(F.col("rep").alias("id"), "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
                .groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near")))

    near = named(lists[0] if len(lists) == 1 else lists[0].union(lists[1]))
    if hashed:
        near = stored(near)
        enough = rows.select("id").distinct().limit(most).count()
        full = near.filter(F.size(F.array_distinct("near.vec_id")) >= enough)
        short = stored(wanted.join(full.select("query"), "query", "left_anti").select("query", "vector"))
        left = short.count()
        if left:
            near = full.union(named(_scanned(points, sum(b["n"] for b in bands), short, left, most)))
    own = asked.join(wanted, "vector").select(F.col("id").alias("query_id"), "query").distinct()
    found = own.join(near, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest).alias("near"))
    return found.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, = tables(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))

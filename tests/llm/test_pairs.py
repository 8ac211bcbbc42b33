"""Near duplicates, neighbours, repeated passages, benchmark passages and the pipeline."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from compare import compare
from conftest import rows_of
from tidemark.llm import ann, decontam, minhash, suffix_dedup
from tidemark.llm.components import components
from tidemark.llm.oracles import CONTAMINATION

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def changed(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = "changed" + str(rng.randint(0, 9999))
    return " ".join(words)


# ---- near duplicates ----

def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    wa, wb = rng.random(300) * 3 + 0.05, rng.random(300) * 3 + 0.05
    true = minhash.similarity((a, wa), (a, wb))
    agree = (minhash.dart_signature(a, wa, 6000) == minhash.dart_signature(a, wb, 6000)).mean()
    assert abs(agree - true) < 0.03
    assert (minhash.dart_signature(a, wa) == minhash.dart_signature(a[::-1].copy(), wa[::-1].copy())).all()


def brute_classes(rows):
    known = minhash._Hashes()
    sets = [(i, minhash.shingles(minhash.word_hashes(t, known))) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if len(a[0]) and len(b[0]) and minhash.similarity(a, b) >= minhash.SIMILAR:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}


def near_rows():
    rng = random.Random(11)
    rows, at = [], 0
    for g in range(6):
        base = prose(rng, 120)
        group = [base] + [changed(rng, base, rng.randint(1, 3)) for _ in range(8)] + [base]
        for t in group:
            rows.append((at := at + 3, t))
    chain = prose(rng, 150)  # each near the next, the ends far apart
    for _ in range(12):
        rows.append((at := at + 3, chain))
        chain = changed(rng, chain, 2)
    base = prose(rng, 120)
    rows += [(900 + k, changed(rng, base, 9)) for k in range(6)]  # alike, but below the bound
    rows += [(1, None), (2, ""), (4, ""), (5, "!?"), (7, "two words"), (8, "Two words!"), (10, "other words"), (2000, prose(rng, 30000)), (None, base), (None, base)]
    rng.shuffle(rows)
    return rows


def test_near_duplicate_classes(spark, docs_of):
    rows = near_rows()
    got = minhash.classes(docs_of(rows, clashing=True))
    found = {r["doc_id"]: r["class_id"] for r in got.collect()}
    assert got.count() == len(rows) and found.pop(None) is None
    assert found == brute_classes(rows)
    kept = minhash.without_duplicates(docs_of(rows, clashing=True))
    assert {r["doc_id"] for r in kept.collect()} == {*found.values(), None}
    assert kept.columns == docs_of(rows, clashing=True).columns


def test_near_duplicates_odd_tables(spark, docs_of):
    assert minhash.classes(docs_of([])).count() == 0
    text = prose(random.Random(1), 40)
    assert rows_of(minhash.classes(docs_of([(5, text), (5, text), (6, text)])), "doc_id", "class_id") == [(5, 5), (5, 5), (6, 5)]


def signed(text):
    """Band keys and bytes of a text, as the signer makes them."""
    values = minhash.dart_signature(*minhash.shingles(minhash.word_hashes(text, minhash._Hashes()))).reshape(minhash.BANDS, minhash.ROWS)
    keys = np.arange(1, minhash.BANDS + 1, dtype=np.uint64) * minhash._MULT
    for i in range(minhash.ROWS):
        keys = minhash.mixed(keys * minhash._MIX2 + values[:, i])
    return keys.view(np.int64), (minhash.mixed(values) & np.uint64(255)).astype(np.uint8)


def test_far_links_where_only_the_bytes_of_an_earlier_band_agree(spark, docs_of):
    rng, number, met = random.Random(17), 0, 0
    while met < 2:  # about 6 of 1,000 such pairs
        number += 1
        assert number < 5_000
        x = prose(rng, 60)
        y = changed(rng, x, 1)
        (keys_x, code_x), (keys_y, code_y) = signed(x), signed(y)
        shared = np.flatnonzero(keys_x == keys_y)
        if not len(shared) or (code_x == code_y).all(axis=1).argmax() == shared[0]:
            continue
        met += 1
        if met == 1:
            r = docs_of([(1, x)]).select(minhash.signer(spark)("text").alias("s")).first()["s"]
            assert r["keys"] == keys_x.tolist() and bytes(r["code"]) == code_x.tobytes()
        found = []
        for band in shared:
            group = pd.DataFrame({"key": keys_x[band], "band": band, "i": 0, "j": 0, "part": 0, "rep": [1, 2], "label": [1, 2], "keys": [keys_x, keys_y],
                                  "code": [code_x.tobytes(), code_y.tobytes()], "text": [x, y]})
            found += minhash._far_links(0.8, minhash._floor(0.8, minhash.COORDINATES))(group).to_numpy().tolist()
        assert found == [[2, 1]]  # once, however many buckets it shares


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 501)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(labels[i] == 0 for i in range(201)) and labels[501] == 500


# ---- neighbours ----

def brute_neighbours(vectors, queries, k):
    good = [(i, np.pad(np.array(v, float), (0, 8 - len(v)))) for i, v in vectors
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        own = [v for i, v in good if i == q]
        for v in own[:1]:
            best = {}
            for i, w in good:
                if i != q:
                    best[i] = max(best.get(i, -9e9), float((v * w).sum()))
            out[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours_of_few_vectors_are_exact(spark, unit):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        v = rng.normal(size=8)
        rows.append((i, [float(x) for x in (v / np.linalg.norm(v) if unit else v)]))
    same = rows[7][1]
    rows += [(100 + k, same) for k in range(40)] + [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (None, same), (9, rows[9][1]), (204, [])]
    if not unit:
        rows += [(300, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS bucket", "3 AS rank")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), nearest=20, probes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_neighbours(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_neighbour_recall(spark):
    found = ann.query(spark, SF).toPandas()
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    v, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    hits = 0
    for q, group in found.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(group["vec_id"]))
    assert found["query_id"].nunique() == (ids % 20 == 0).sum() and hits / len(found) >= 0.9


LENGTHS = {"outlier": lambda rng, n: np.where(np.arange(n) == 3, 100.0, 1.0), "uniform": lambda rng, n: rng.uniform(0.5, 1.5, n),
           "log-normal": lambda rng, n: rng.lognormal(size=n)}


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("lengths", sorted(LENGTHS))
@pytest.mark.parametrize("sizes", [{}, {"scanned": 40}])
def test_neighbour_recall_with_unequal_lengths(spark, lengths, sizes):
    v = np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()["embedding"]).astype(float)
    v *= LENGTHS[lengths](np.random.default_rng(4), len(v))[:, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found, hits = ann.search(df, df.filter("vec_id % 20 = 0"), **sizes).toPandas(), 0
    for q in range(0, len(v), 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found["vec_id"][found["query_id"] == q]))
    assert len(found) == len(v) and hits / len(found) >= (0.9 if sizes else 1)


@pytest.mark.parametrize("n, sizes", [(12, {}), (25, {}), (25, {"scanned": 0})])
def test_neighbours_are_never_too_few(spark, n, sizes):
    v = np.random.default_rng(8).normal(size=(n, 64))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = ann.search(df, df, **sizes).toPandas()
    assert (found.groupby("query_id").size() == min(20, n - 1)).all() and found["query_id"].nunique() == n


def test_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(8)
    for trial in range(20):
        vectors = np.unique(rng.integers(-1, 2, (400, 6)), axis=0).astype(float)
        vectors = np.concatenate([vectors, vectors[:40]])
        ids = rng.permutation(len(vectors))
        table = pd.DataFrame({"id": ids, "vector": list(vectors)})
        got = ann._ranked(21)(table.iloc[:30], table)
        for query, found, scores in zip(got["query"], got["ids"], got["scores"]):
            q = vectors[np.flatnonzero(ids == query)[0]]
            want = sorted((-float(q @ v), int(i)) for i, v in zip(ids, vectors))[:21]
            assert [int(i) for i in found] == [i for _, i in want] and np.allclose(scores, [-s for s, _ in want])


def test_a_query_is_sent_to_a_cell_once():
    """Two functions: 24 rows a query and table, not 576, and as many rows of a bucket in the end."""
    rng = np.random.default_rng(3)
    batch = pd.DataFrame({"id": np.arange(2_100), "vector": list(rng.normal(size=(2_100, 64)).astype(np.float32)), "band": 0, "functions": 2})
    made = [len(rows) for rows in ann._hashed({2: 1}, 64, 24)(iter([batch]))]
    assert sum(made) == 24 * 2_100 and max(made) <= 50_000
    assert sum(len(rows) for rows in ann._hashed({2: 1}, 64, None)(iter([batch]))) == 2_100


def test_a_query_meets_the_vectors_of_its_buckets_only():
    rng = np.random.default_rng(5)
    vectors, axes = rng.normal(size=(300, 8)), rng.integers(0, 16, 300).astype(np.int32)
    table = pd.DataFrame({"id": np.arange(300), "vector": list(vectors), "lows": [x.tobytes() for x in axes]})
    asked = table.iloc[:40].assign(lows=[rng.permutation(16)[:3].astype(np.int32).tobytes() for _ in range(40)])
    got = ann._ranked(21)(asked, table)
    for query, ids in zip(got["query"], got["ids"]):
        met = np.flatnonzero(np.isin(axes, np.frombuffer(asked["lows"][query], dtype=np.int32)))
        assert list(ids) == sorted(met, key=lambda i: -float(vectors[query] @ vectors[i]))[:21]
    assert len(got) == 40


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_neighbour_recall_with_two_functions(spark):
    v = np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()["embedding"]).astype(float)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found, hits = ann.search(df, df.filter("vec_id % 100 = 0"), per_bucket=0.5, scanned=0).toPandas(), 0
    for q in range(0, len(v), 100):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(found["vec_id"][found["query_id"] == q]))
    assert len(found) == len(v) // 5 and hits / len(found) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


# ---- repeated passages ----

def brute_removed(rows):
    first, out = {}, []
    texts = sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda x: x[0])
    for i, b in texts:
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        left = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def passage_rows():
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (7, 8, 9, 12, 40, 200)] + ["é" * 30, "ab" * 60, "z" * 300]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared)[rng.choice([0, 0, 1, 13]):])
        rows.append((i * 7 % 97 - 5, rng.choice([" ", "é", ""]).join(parts)))
    whole = rows[3][1]
    rows += [(400, whole), (401, changed(rng, prose(rng, 60) + whole, 1)), (402, ""), (403, None), (404, "x" * 49), (405, "x" * 50), (406, "x" * 50),
             (500, rows[0][1]), (500, rows[0][1]), (500, rows[1][1]), (None, whole), (None, None)]
    rng.shuffle(rows)
    return rows


def test_passages_equal_brute_force(spark, docs_of):
    rows = passage_rows()
    got = suffix_dedup.passages(docs_of(rows, clashing=True).repartition(5))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows)
    assert suffix_dedup.passages(docs_of([])).count() == 0


def test_passages_with_pieces_shards_and_hot_anchors(spark, docs_of, monkeypatch):
    rng = random.Random(2)
    line = prose(rng, 12)
    rows = [(i, prose(rng, 5) + line + prose(rng, 5)) for i in range(60)] + [(100, line * 30), (101, prose(rng, 400)), (102, "q" + line * 30)]
    ids = np.array([i for i, _ in rows])
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    pieces = [(int(d), int(o)) for data, window, document, offset in suffix_dedup.pieces_of(texts) for d, o in zip(document[window], offset[window])]
    assert sorted(pieces) == [(k, p) for k, t in enumerate(texts) for p in range(len(t) - 49)]  # every window once
    monkeypatch.undo()
    assert (suffix_dedup._shard_entries(ids, ids, texts)[0] == suffix_dedup._MARK).any()  # the line's edges are common
    assert rows_of(suffix_dedup.passages(docs_of(rows).repartition(4)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255) | st.integers(97, 98), st.integers(0, 3)), max_size=80), st.sampled_from([3, 8, 11, 20]))
def test_previous_factors_brute_force(pairs, depth):
    letters, document = np.array([x for x, _ in pairs], dtype=np.uint8), np.array([d for _, d in pairs], dtype=np.int64)
    places = np.arange(max(0, len(pairs) - depth + 1))
    order, rank = suffix_dedup.suffix_array(letters, places, depth)
    runs = [tuple(letters[i:i + depth].tolist()) for i in places]
    assert [runs[i] for i in order] == sorted(runs)
    found = suffix_dedup.previous_factors(order, rank, document[places])
    for i in places:
        assert found[i] == any(runs[j] == runs[i] and document[j] < document[i] for j in places)


def test_cut_texts_stay_texts(spark, docs_of):
    rows = [(1, "é" * 40), (2, "aé" + "é" * 39 + "b"), (3, None), (None, "é" * 40)]
    got = suffix_dedup.without_repeats(docs_of(rows, clashing=True))
    assert rows_of(got, "doc_id", "text", "n_chars") == sorted([(1, "é" * 40, 40), (2, "ab", 2), (3, None, None), (None, "é" * 40, 40)], key=repr)
    assert got.columns == docs_of(rows, clashing=True).columns


# ---- benchmark passages ----

def brute_hits(docs, items):
    out = []
    for i, text in docs:
        words = decontam.words_of(text)
        hit, names = set(), set()
        for item, t in items:
            own = decontam.words_of(t)
            n = min(10, len(own))
            for a in range(len(own) - n + 1) if item is not None and own else ():
                for p in range(len(words) - n + 1):
                    if words[p:p + n] == own[a:a + n]:
                        hit.update(range(p, p + n))
                        names.add(str(item))
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_words": 20, "shard_words": 50}])
def test_contamination_brute_force(spark, docs_of, sizes):
    rng = random.Random(31)
    items = [(k, prose(rng, rng.choice([12, 25, 10, 9]))) for k in range(8)] + [(50, "Short one"), (51, "the"), (52, ""), (53, None), (None, prose(rng, 12)), (54, "Short one"), (0, "x y")]
    docs = []
    for i in range(40):
        text = prose(rng, 30)
        for _ in range(rng.randint(0, 2)):
            own = (items[rng.randint(0, 7)][1]).split()
            a = rng.randint(0, 3)
            text += " " + ", ".join(own[a:a + rng.randint(8, 14)]).upper() + " " + prose(rng, 3)
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, "É short-one? THE"), (None, items[0][1]), (93, items[1][1]), (93, items[1][1]), (94, "the " * 40000)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words")
    got = decontam.contamination(docs_of(docs, clashing=True), bench, **sizes)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(docs, items)
    kept = decontam.clean_documents(docs_of(docs, clashing=True), bench, **sizes)
    assert kept.count() == sum(not r[-1] for r in brute_hits(docs, items))
    assert decontam.contamination(docs_of([]), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs_of(docs), bench.limit(0)).collect()} == {0}


def test_benchmark_items_without_an_id_are_searched(spark, docs_of, root):
    rng = random.Random(5)
    nameless, named = prose(rng, 14), prose(rng, 12)
    bench = spark.createDataFrame([(None, nameless), (3, named)], "item_id long, text string")
    docs = docs_of([(1, "so " + nameless + " on"), (2, nameless + " " + named), (3, prose(rng, 20))])
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(14, 1, True), (26, 2, True), (0, 0, False)]
    assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["items_sha256"] == hashlib.sha256(b"3").hexdigest()
    bench.coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    docs.coalesce(1).write.parquet(f"{root}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    assert compare(spark, con, decontam.query, CONTAMINATION, root) is None
    assert [tuple(m) for m in got[2]["matches"]] == [(None, 0, 14), (3, 14, 12)]
    assert [r["doc_id"] for r in decontam.clean_documents(docs, bench).collect()] == [3]


def test_longest_matches_join():
    assert decontam.longest([(1, 5, 10), (1, 6, 10), (1, 7, 10), (1, 30, 10), (2, 6, 10)]) == [(1, 5, 12), (1, 30, 10), (2, 6, 10)]


# ---- pipeline ----

@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            rows = out.collect()
            if name == "suffix-array dedup":
                want = {r[0]: r[2] for r in brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])}
                old = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
                assert all(0 <= len(r["text"].encode()) - (old[r["doc_id"]] - want[r["doc_id"]]) <= 3 * want[r["doc_id"]] for r in rows)
                assert ids and set(ids) == before
            if name == "MinHash near-dedup":
                want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
                assert set(ids) == set(want.values())
            if name == "benchmark decontamination":
                items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
                assert set(ids) == {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items) if not r[-1]}
            docs = spark.createDataFrame(rows, out.schema)
        else:
            assert set(ids) == before
        before = set(ids)


def test_stages_take_empty_and_odd_tables(spark, docs_of):
    odd = docs_of([(None, None), (1, None), (2, ""), (2, ""), (3, "some words of a text " * 9), (4, "some words of a text " * 9)], clashing=True).selectExpr("*", "NULL AS nothing")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns

"""Alignment of two tokenizers against brute force from the libraries."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def content_a(tokenizer, letters, i):
    return bytes(letters[c] for c in tokenizer.id_to_token(i))


def content_b(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def brute(rows):
    ta, tb = libraries()
    letters = alignment.byte_letters()
    docs, held = [], Counter()
    for i, text in rows:
        a = ta.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        pa_, pb = [content_a(ta, letters, x) for x in a], [content_b(tb, x) for x in b]
        want = f" {text}".encode()
        if not text or b"".join(pa_) != want or b"".join(pb) != want:
            docs.append((i, [], [], [], ""))
            continue

        def ends(parts):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            return out

        ea, eb = ends(pa_), ends(pb)
        groups, start = [], 0
        for end in sorted(set(ea) & set(eb)):
            groups.append(([x for x, e in zip(a, ea) if start < e <= end], [x for x, e in zip(b, eb) if start < e <= end]))
            start = end
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        text_of = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        docs.append((i, a, b, links, hashlib.sha256(text_of.encode()).hexdigest(), len(groups)))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, a, b, links, sha, *n in docs:
        out.append((i, len(a), len(b), n[0] if n else 0, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(6)
    words = ["the", "house", "naïve", "Straße", "éa", "日本語", "foo_bar", "<|endoftext|>", "<s>", "</s>", "3.14159", "\t", "  ", "\n\n", "🙂", "ﬁ", "<0x41>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    rows += [(None, "the house"), (60, None), (61, ""), (62, " "), (5, "repeated row"), (5, "repeated row"), (63, "▁ under"), (64, "nul\0byte"),
             (65, "a" * 3000), (66, "ab" * 2000 + " " * 70), (67, "x" * 50 + "日本" * 400), (68, "long text " * 4000), (69, "́")]
    return rows


def test_scored_equals_brute_force(spark, docs_of):
    rows = texts()
    want = brute(rows)
    got = alignment.scored(docs_of(rows, clashing=True).withColumnRenamed("bucket", "pairs").repartition(3))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == want
    cut = alignment.scored(docs_of(rows), block_bytes=300, slice_bytes=100)
    assert sorted(map(tuple, cut.collect()), key=repr) == want
    assert alignment.scored(docs_of([])).count() == 0
    assert [tuple(r) for r in alignment.scored(docs_of([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_as_text(spark, docs_of):
    row = alignment.aligned(docs_of([(1, "the house")]), text=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    assert row["groups"].count(";") == row["n_groups"] - 1 and row["groups"].count("|") == row["n_groups"]


def test_links_in_slices_are_the_same():
    rng = random.Random(2)
    a = alignment._counted(pa.array([rng.randint(0, 5) for _ in range(200)], pa.int64()), pa.array([rng.randint(0, 9) for _ in range(200)], pa.int32()))
    b = alignment._counted(pa.array([rng.randint(0, 5) for _ in range(200)], pa.int64()), pa.array([rng.randint(0, 9) for _ in range(200)], pa.int32()))
    doc = pa.array([0, 0, 1, 1, 2, 2], pa.int64())

    def rows(most):
        made = alignment.links(a, b, doc, most)
        return sorted(zip(*[made[c].to_pylist() for c in ("key", "times")]))

    assert rows(1) == rows(7) == rows(1 << 20)
    assert sum(t for _, t in rows(50)) == sum(
        x["count_all"] * y["count_all"] for x in a.to_pylist() for y in b.to_pylist() if x["group"] == y["group"])

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts

OWN = {name: bpe.Bpe(open(public_tokenizers.path(name), "rb").read()) for name in (bpe.WORD_FILE, bpe.BYTE_FILE)}
REF = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in OWN}
ODD = ["", " ", "a" * 4000, "the" * 900, "İß ΣΑΣ", "é é", "漢字 かな", "<|endoftext|>x<|startoftext|>", "it's we'll  \n\n x", "12345", "!?!?", "\x1c\x85\xa0z"]


@pytest.mark.parametrize("name", OWN)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aeth nos'd\n<|>!1é", max_size=80))
def test_ids_equal_the_library(name, text):
    assert OWN[name].encode(text) == REF[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", OWN)
@pytest.mark.parametrize("text", ODD)
def test_odd_texts_and_decoding(name, text):
    ids = OWN[name].encode(text)
    assert ids == REF[name].encode(text, add_special_tokens=False).ids
    assert OWN[name].decode(ids) == REF[name].decode(ids, skip_special_tokens=False)


def test_byte_vocabulary_round_trip():
    for text in ODD:
        assert OWN[bpe.BYTE_FILE].decode(OWN[bpe.BYTE_FILE].encode(text)) == text


def test_compatible_means_joined_text_keeps_both():
    own, rng = OWN[bpe.BYTE_FILE], random.Random(4)
    ids = list(own.parts)
    for _ in range(3000):
        a, b = rng.choice(ids[:800]), rng.choice(ids[:800])
        text = own.decode([a, b])
        if own.pieces.findall(text) == [text]:
            assert own.compatible(a, b) == (REF[bpe.BYTE_FILE].encode(text).ids == [a, b])


def test_query_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "Hello there, hello"), (3, "Hello there, hello"), (None, "x")]
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.token_digests(docs_of(rows, clashing=True)).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 4), (None, 1)}
    ids = REF[bpe.WORD_FILE].encode("Hello there, hello", add_special_tokens=False).ids
    assert got[3, 4]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert got[3, 4]["decoded_sha256"] == hashlib.sha256(REF[bpe.WORD_FILE].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[1, 0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(docs_of([])).count() == 0


def test_columns_both_ways(spark, docs_of):
    encoded = bpe.encode_table(docs_of([(1, "one two"), (2, None)]))
    back = bpe.decoder(spark)(encoded["ids"])
    assert {r["doc_id"]: r["t"] for r in encoded.select("doc_id", back.alias("t")).collect()} == {1: "one</w> two</w>", 2: ""}


def test_counts_after_edits_equal_encoding_anew():
    own, ref, rng = OWN[bpe.BYTE_FILE], REF[bpe.BYTE_FILE], random.Random(9)
    parts = ["a", " ", "  ", "\n", "'s", "don't", "1", "é", "!!", "<|endoftext|>", "<|endof", "text|>", "\t \n", "hello world", " x"]
    for size in (0, 1, 30, 3000):
        text = "".join(rng.choice(parts) for _ in range(size))
        counted = token_counts.Counted(text, own)
        for _ in range(40):
            start, length = rng.randint(0, len(text) + 3), rng.choice([0, 1, 3, 10, 200])
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 400])))
            at = min(start, len(text))
            text = text[:at] + new + text[at + length:]
            counted.edit(start, length, new)
            assert counted.text() == text
            assert counted.tokens == len(ref.encode(text, add_special_tokens=False).ids)
            assert counted.characters == len(text)


def test_an_edit_encodes_its_surroundings_only():
    counted = token_counts.Counted(" ".join(f"word{i}" for i in range(50_000)), OWN[bpe.BYTE_FILE])
    counted.encoded = 0
    counted.edit(100_000, 5, "something else")
    assert counted.encoded < 100


def test_counts_query(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "Some text of a document, long enough to edit."), (3, "Some text of a document, long enough to edit.")]
    docs = docs_of(rows, clashing=True)
    edits = token_counts.derived_edits()
    got = token_counts.counts_after(docs, edits)
    listed = {r["doc_id"]: r["e"] for r in docs.select("doc_id", edits.alias("e")).collect()}
    for r in got.collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["n_before"] == len(REF[bpe.BYTE_FILE].encode(text).ids)
        for e in listed[r["doc_id"]]:
            at = min(e["start"], len(text))
            text = text[:at] + (e["replacement"] or "") + text[at + e["length"]:]
        assert (r["n_after"], r["n_chars_after"]) == (len(REF[bpe.BYTE_FILE].encode(text).ids), len(text))
    none = token_counts.counts_after(docs, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None))
    assert all(r["n_before"] == r["n_after"] for r in none.collect())
    assert token_counts.counts_after(docs_of([]), edits).count() == 0

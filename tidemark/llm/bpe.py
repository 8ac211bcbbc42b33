"""BPE encoding and decoding by a dynamic program over prefixes.

For every prefix of a pre-token exactly one token can be the last one of its
encoding.  An automaton over the vocabulary yields all tokens that end at a
position; of these, the one that is compatible with the last token of the rest
is kept, and following the back-pointers from the end emits the ids.  Two
tokens are compatible if no merge across their border would have been applied
before the merges that made them, which a walk up the touching edges decides.
The work is linear in the length of a pre-token, however long it is.

Cases: NULL and empty text have no ids (the digest of nothing); very long
texts and pre-tokens are encoded whole; repeated rows give equal rows; an empty
table gives an empty result; further columns of the input are not looked at.
Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Sequence

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import on_text

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
_END = "Ā"  # stands for the mark of a word's end; bytes are U+0000 to U+00FF
_NEVER = 1 << 60
_WORDS, _PAIRS = 400_000, 1_000_000  # entries a task remembers before it starts anew

# Letters of which all Unicode versions say the same; a text with others is split by the library's own tables.
_UNSETTLED = regex.compile(r"[^\0-\u024f\u0370-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fbf\uac00-\ud7a3]")
# Letters, digits and the rest, as byte-level vocabularies split text (fixed pattern).
_BYTE_LEVEL = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
               r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [], 256
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class _Remembered(dict):
    """Pre-tokens encoded so far."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        out = self[piece] = self.make(piece)
        return out


class Bpe:
    """A vocabulary file read for encoding, counting and decoding."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        back = {letter: chr(byte) for byte, letter in enumerate(letters)}

        def own(token: str) -> str:
            stem = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            return "".join(back[c] for c in stem) + (_END if stem is not token else "")

        self.spelled = {number: token for token, number in model["vocab"].items()}
        ids = {own(token): number for token, number in model["vocab"].items()}
        self.length = {number: len(token) for token, number in ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (own(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = (ids[left], ids[right])
            whole = ids[left + right]
            self.rank.setdefault(pair, rank)
            if whole not in self.made:
                self.parts[whole], self.made[whole] = pair, rank
        self.automaton = ahocorasick.Automaton()
        for token, number in ids.items():
            self.automaton.add_word(token, number)
        self.automaton.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.spelled.update({number: token for token, number in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = [x["type"] for x in steps]
        # White space is only made uniform in vocabularies whose split then drops it, so that step is left out.
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        splits = [x for x in (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]) if x["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}") if splits else _BYTE_LEVEL
        self.pieces = regex.compile(pattern)
        self.library = Tokenizer.from_str(content.decode("utf-8"))  # its tables of letters only
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.unletter = {letter: byte for byte, letter in enumerate(letters)}
        self._words = _Remembered(self.word)
        self.sizes = _Remembered(lambda piece: 1 if piece in self.special else len(self.word(piece)) // 4)  # tokens of a pre-token
        self._pairs: dict[int, bool] = {}

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: a final sigma is lowered as any other
            text = text.replace("Σ", "σ").lower()
        return text

    @staticmethod
    def unsettled(text: str) -> bool:
        return not text.isascii() and _UNSETTLED.search(text) is not None

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not self.unsettled(text):
            return self.pieces.findall(self.normal(text))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(self.unletter[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens along one edge of ``token``, the shortest first."""
        chain = [token]
        while chain[-1] in self.parts:
            chain.append(self.parts[chain[-1]][side])
        return chain[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their joined text is encoded."""
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        apart = True
        while True:
            across = self.rank.get((a[i], b[j]), _NEVER)
            up_left = self.made[a[i + 1]] if i + 1 < len(a) else _NEVER
            up_right = self.made[b[j + 1]] if j + 1 < len(b) else _NEVER
            if across < up_left and across <= up_right and across != _NEVER:
                apart = False
                break
            if up_left == up_right == _NEVER:
                break
            if up_left <= up_right:  # at one rank, the pair further left is merged first
                i += 1
            else:
                j += 1
        if len(self._pairs) >= _PAIRS:
            self._pairs.clear()
        self._pairs[left << 32 | right] = apart
        return apart

    def word(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian 32-bit integers."""
        units = piece.encode("utf-8").decode("latin-1")
        inner = len(units) if self.suffix else -1  # with an end mark, no token ends between the last byte and the mark
        if self.suffix:
            units += _END
        last: list[int] = [-1] * (len(units) + 1)
        length, pairs = self.length, self._pairs
        for end, token in self.automaton.iter(units):
            here = end + 1
            if last[here] >= 0 or here == inner:
                continue
            start = here - length[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                apart = pairs.get(before << 32 | token)
                if not (self.compatible(before, token) if apart is None else apart):
                    continue
            last[here] = token
        ids, at = [], len(units)
        while at > 0:
            ids.append(last[at])
            at -= length[last[at]]
        return struct.pack(f"<{len(ids)}I", *ids[::-1])

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text, packed; special tokens written in it count as such."""
        if not text:
            return b""
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                if len(self._words) >= _WORDS:
                    self._words.clear()
                out += map(self._words.__getitem__, self.split(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ``ids``, special tokens included; without a decoder, tokens stand apart by spaces."""
        tokens = [x for x in map(self.spelled.get, ids) if x is not None]
        if not self.bytewise:
            return " ".join(tokens)
        out = bytearray()
        for token in tokens:
            out += token.encode("utf-8") if token in self.special else bytes(self.unletter[c] for c in token)
        return out.decode("utf-8", "replace")


_read: dict[str, Bpe] = {}


def read_once(content: bytes) -> Bpe:
    """The vocabulary, kept by the worker process for its later tasks."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _read:
        _read.clear()
        _read[key] = Bpe(content)
    return _read[key]


def vocabulary(spark: SparkSession, path: str | None = None, name: str = WORD_FILE):
    """Broadcast of a vocabulary file (one to two MB, whatever the input)."""
    with open(path or public_tokenizers.path(name), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(spark: SparkSession, path: str | None = None, name: str = WORD_FILE):
    """Column function: text to its array of ids."""
    content = vocabulary(spark, path, name)
    return on_text(spark, lambda: read_once(content.value).encode, "array<int>")


def decoder(spark: SparkSession, path: str | None = None, name: str = WORD_FILE):
    """Column function: array of ids to text (NULL stays NULL)."""
    content = vocabulary(spark, path, name)

    def make():
        bpe = read_once(content.value)
        return lambda ids: None if ids is None else bpe.decode([int(i) for i in ids])

    return on_text(spark, make, "string")


def round_trip(spark: SparkSession, path: str | None = None, name: str = WORD_FILE):
    """Column function: text to its number of ids and the digests of ids and decoded text."""
    content = vocabulary(spark, path, name)

    def make():
        bpe = read_once(content.value)

        def one(text: str | None) -> dict:
            packed = bpe.packed(text)
            ids = np.frombuffer(packed, dtype="<u4").tolist()
            return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(packed).hexdigest(),
                    "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest()}

        return one

    return on_text(spark, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_table(docs: DataFrame, text: str | Column = "text", **vocab: str) -> DataFrame:
    """doc_id and ``ids`` of every document."""
    run = encoder(docs.sparkSession, **vocab)
    return docs.select("doc_id", run(F.col(text) if isinstance(text, str) else text).alias("ids"))


def token_digests(docs: DataFrame, **vocab: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    made = docs.select("doc_id", round_trip(docs.sparkSession, **vocab)(F.col("text")).alias("made"))
    return made.select("doc_id", "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")

"""Byte-level BPE through sentencepiece: a model is serialised from the ranks, pre-tokens are encoded, ids decoded.

Bytes become characters one to one, every rank becomes a piece whose score is the negative rank, and normalisation is
the identity, so sentencepiece merges the same pairs in the same order as byte-pair merging by lowest rank does.

Defined cases: a null text counts as empty; the empty text has no ids and decodes to no bytes; repeated rows are
encoded each; other columns are ignored; a token's length has no bound (merging is O(n log n)).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import table

#: Parts of texts whose ids a Python worker remembers; beyond it the memory is emptied, results stay the same.
REMEMBERED = 800_000
#: Characters of text encoded together, about; a longer text is encoded alone.
TOGETHER = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where that is visible and no space, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; the i-th piece is that of the i-th smallest rank, the last one is <unk>."""
    chars = byte_characters()
    out = bytearray()
    order = sorted(ranks, key=ranks.__getitem__)
    for token in order:
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -ranks[token]) + _number(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """encode and decode by the rank file at path; texts are first split by pattern."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        order = sorted(ranks, key=ranks.__getitem__)
        self.of_piece = [ranks[t] for t in order]
        self.same = self.of_piece == list(range(len(order)))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.chars = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.to_chars = {b: c for b, c in enumerate(self.chars)}
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.after_space: dict[str, tuple[int, ...]] = {}

    def _learn(self, found: list[list[str]]) -> None:
        """Ids of the pre-tokens not met so far; one that is a token itself is that token, as the merges need not reach it."""
        if len(self.tokens) > REMEMBERED:
            self.tokens.clear()
        new = list(set(chain.from_iterable(found)).difference(self.tokens))
        rest, mapped = [], []
        for token in new:
            raw = token.encode("utf-8", "replace")
            if (r := self.ranks.get(raw)) is not None:
                self.tokens[token] = (r,)
            else:
                rest.append(token)
                mapped.append(raw.decode("latin-1").translate(self.to_chars))
        for token, ids in zip(rest, self.model.encode(mapped, num_threads=1) if rest else [], strict=True):
            self.tokens[token] = tuple(ids) if self.same else tuple(self.of_piece[i] for i in ids)

    def _remember(self, parts: list[str]) -> None:
        """Ids of parts that follow a space: in all of them together, only the first pre-token of each starts with a space."""
        found = self.find(" " + " ".join(parts))
        self._learn([found])
        each: list[list[int]] = []
        for token in found:
            if token[0] == " ":
                each.append(list(self.tokens[token]))
            else:
                each[-1] += self.tokens[token]
        self.after_space.update(zip(parts, map(tuple, each), strict=True))

    def encode_after_space(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Ids of each part with a space before it, each for itself."""
        if len(self.after_space) > REMEMBERED:
            self.after_space.clear()
        new = list(set(parts).difference(self.after_space))
        if plain := [p for p in new if p and p == p.strip()]:
            self._remember(plain)
        for p in new:
            if p not in self.after_space:
                found = self.find(" " + p)
                self._learn([found])
                self.after_space[p] = tuple(chain.from_iterable(map(self.tokens.__getitem__, found)))
        return list(map(self.after_space.__getitem__, parts))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.

        A space between two visible characters always starts a pre-token. So texts are cut at their spaces, and the
        ids of a part are remembered. Texts with other runs of white space beside a space are split as a whole.
        """
        if len(self.after_space) > REMEMBERED:
            self.after_space.clear()
        cut = [t.split(" ") for t in texts]
        if new := [p for p in set(chain.from_iterable(x[1:] for x in cut)).difference(self.after_space) if p and p == p.strip()]:
            self._remember(new)
        known = [list(map(self.after_space.get, x[1:])) for x in cut]
        whole = [None in ids or bool(ids) and not (x[0] and x[0] == x[0].rstrip()) for x, ids in zip(cut, known, strict=True)]
        first = [self.find(t if w else x[0]) for t, x, w in zip(texts, cut, whole, strict=True)]
        self._learn(first)
        return [list(chain(chain.from_iterable(map(self.tokens.__getitem__, f)), () if w else chain.from_iterable(ids))) for f, ids, w in zip(first, known, whole, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def together(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Slices of (ids, texts) of about TOGETHER characters; null texts are empty."""
    start, size, part = 0, 0, []
    for i, t in enumerate(batch.column(1)):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= TOGETHER or i == batch.num_rows - 1:
            yield batch.column(0).slice(start, len(part)), part
            start, size, part = i + 1, 0, []


def encode_documents(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows (doc_id, ids array<int>) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for ids, part in together(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.encode_batch(part), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, decoded binary) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            out = [own.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every document and keeps only digests of both, so that no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for doc_ids, part in together(b):
                n, a, d = [], [], []
                for ids in own.encode_batch(part):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                    d.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

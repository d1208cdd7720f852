"""Packing documents into training sequences along a space-filling curve.

A document's tokens are hashed into buckets and projected to a few dimensions; documents are sorted by the Hilbert key
of that point, so that neighbours on the curve hold like text, and laid end to end in this order. Every ``length``
tokens a sequence ends and the document goes on in the next one. Only the end of the whole order is short: it is cut
into sequences whose lengths are powers of two, which need no padding. So there is no padding at all.

Tokenising happens once; ids travel as compressed 16-bit numbers where the vocabulary allows. Equal keys (copies) are
spread by a row number, so a group of copies of any size is sorted by many tasks. The driver gets one number per
sorted partition.

Defined cases: a null text is empty and has only the end id; empty and very long texts, ties and repeated rows are
packed like others, each row by itself; an empty table gives no rows; other columns pass through ``packed`` when asked for.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm.byte_bpe import byte_characters
from sievework.llm.common import release_memory, stored, table

END_ID = 1
BUCKETS, DIMENSIONS, DEPTH = 512, 4, 12
#: Words whose ids a task remembers, and their characters; beyond either the memory is emptied, results stay the same.
REMEMBERED, REMEMBERED_CHARACTERS = 600_000, 20_000_000
#: Bytes of text that are cut into words at a time.
TOGETHER = 6_000_000

#: Parts whose normal form is plain: visible ASCII and Latin-1 letters.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
#: The tokenizer's own cut of such parts in lower case, and line ends.
CUT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall


class WordTokens:
    """Ids of whole texts by a tokenizer file that drops white space, so that no token spans a space or line end.

    Texts are cut there and their distinct parts, whatever their ASCII case, which the tokenizer lowers, numbered by Arrow;
    only these are looked up, and the ids are gathered by number. The ids of each part are remembered, as the bytes of 32-bit numbers. New plain parts are cut as the
    tokenizer would, and each new cut goes to its merges alone; parts that may hold a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        self.merge = self.own.model.tokenize
        self.to_chars = dict(enumerate(byte_characters()))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.cuts: dict[str, bytes] = {}
        self.size = 0

    def _merged(self, cuts: set[str]) -> None:
        fresh = list(cuts)
        mapped = "\n".join(fresh).encode().decode("latin-1").translate(self.to_chars).split(self.to_chars[10])
        for a in range(0, len(fresh), 10_000):
            each = [[t.id for t in self.merge(word)] for word in mapped[a : a + 10_000]]
            ends = (4 * np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))).tolist()
            raw = np.fromiter(chain.from_iterable(each), np.uint32, ends[-1] >> 2).tobytes()
            self.cuts.update(zip(fresh[a : a + 10_000], map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of parts, which are remembered."""
        if len(self.known) + len(new) > REMEMBERED or self.size > REMEMBERED_CHARACTERS:
            self.forget()
        plain = [p for p in new if PLAIN(p) and "<|" not in p]
        letters, mixed = [p for p in plain if p.isalpha()], [p for p in plain if not p.isalpha()]
        alone = list(map(str.lower, letters))  # letters only are one cut
        cuts = CUT("\n".join(mixed).lower())
        if fresh := set(alone).union(cuts).difference(self.cuts, ("\n",)):
            self._merged(fresh)
        self.known.update(zip(letters, map(self.cuts.__getitem__, alone), strict=True))
        if mixed:
            held: list[bytes] = []
            each, ids = iter(mixed), self.cuts
            for cut in cuts:
                if cut == "\n":
                    self.known[next(each)] = held[0] if len(held) == 1 else b"".join(held)
                    held = []
                else:
                    held.append(ids[cut])
            self.known[next(each)] = b"".join(held)
        rest = [p for p in new if p not in self.known]
        self.known.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in self.own.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        self.size += sum(map(len, new))
        return list(map(self.known.__getitem__, new))

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        spaced = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        if not pc.any(pc.match_substring(spaced, "<|")).as_py():  # the tokenizer's special tokens are told by their case
            spaced = pc.ascii_lower(spaced)
        parts = pc.split_pattern(spaced, " ")
        numbered = parts.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False)
        found = list(map(self.known.get, words))
        if new := [i for i, x in enumerate(found) if x is None]:
            for i, x in zip(new, self._learn(words[new].tolist()), strict=True):
                found[i] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        number = numbered.indices.to_numpy()
        flat, n = np.frombuffer(b"".join(found), np.uint32), sizes[number]
        after = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - after + n, n) + np.arange(int(after[-1]))]
        ends = np.concatenate([[0], after])[np.cumsum(pc.list_value_length(parts).to_numpy())]
        return np.split(ids, ends[:-1])


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


def points(ids: list[np.ndarray]) -> np.ndarray:
    """A point of [0, 1) ^ DIMENSIONS for each document: its hashed counts on the unit sphere, projected."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    bucket = (np.concatenate(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64)
    counts = np.bincount(row * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    x = np.sqrt(counts)
    x = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-9) @ projection()
    return np.clip(0.5 + x / 6, 0, 1 - 1e-9)


def hilbert_keys(p: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The distance of each point along the Hilbert curve, by Skilling's transposition."""
    n, x = p.shape[1], (p * (1 << depth)).astype(np.int64).T.copy()
    q = 1 << (depth - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in reversed(range(depth)):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    raw = ids.astype("<u2" if small else "<u4").tobytes()
    return (b"s" if small else b"l") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_ids(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.frombuffer(raw, "<u2" if blob[:1] == b"s" else "<u4").astype("<u4")


def tokenised(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, key, n, ids) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokens(path)  # with the words that this worker's last task has met
        gc.disable()  # what is made here has no cycles, and there is much of it
        try:
            for b in batches:
                all_texts = b.column(1).fill_null("")
                sizes = np.cumsum(pc.binary_length(all_texts).to_numpy())
                start = 0
                while start < b.num_rows:
                    before = int(sizes[start - 1]) if start else 0
                    end = max(start + 1, int(np.searchsorted(sizes, before + TOGETHER)))
                    ids = [np.append(x, np.uint32(END_ID)) for x in own.encode_batch(all_texts.slice(start, end - start))]
                    keys = np.concatenate([hilbert_keys(points(ids[i : i + 256])) for i in range(0, len(ids), 256)])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack_ids(x) for x in ids], pa.binary())], ["doc_id", "key", "n", "ids"])
                    start = end
        finally:
            gc.enable()
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, key long, n long, ids binary")


def cuts(total: int, length: int) -> tuple[int, list[tuple[int, int]]]:
    """The tokens in full sequences, and (start, length) of those that hold the rest: powers of two, the largest first."""
    at = full = total // length * length
    rest = []
    while at < total:
        n = 1 << (total - at).bit_length() - 1
        rest.append((at, n))
        at += n
    return full, rest


def packed(docs: DataFrame, path: str, length: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary; or null).

    ``length`` is a power of two.
    """
    spark = docs.sparkSession
    rows = stored(tokenised(docs, path), "tokens").withColumn("row", F.monotonically_increasing_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(before.astype(np.int64))], ["doc_id", "n", "ids", "part", "before"])

    in_order = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "row").sortWithinPartitions("key", "row").select("doc_id", "n", "ids")
    order = stored(in_order.mapInArrow(number, "doc_id long, n long, ids binary, part int, before long"), "order")
    base, total = {}, 0
    for part, n in sorted(map(tuple, order.groupBy("part").agg(F.sum("n")).collect())):
        base[part] = total
        total += n
    full, rest = cuts(total, length)
    edges = np.array([s for s, _ in rest] + [total])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 7, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        out, size = [], 0
        for b in batches:
            for doc_id, n, blob, part, before in zip(*b.columns, strict=True):
                doc_id, n, begin, start = doc_id.as_py(), n.as_py(), base[part.as_py()] + before.as_py(), 0
                ids = unpack_ids(blob.as_py())
                while start < n:
                    at = begin + start
                    if at < full:
                        sequence, offset, end = at // length, at % length, at // length * length + length
                    else:
                        k = int(np.searchsorted(edges, at, "right")) - 1
                        sequence, offset, end = full // length + k, at - int(edges[k]), int(edges[k + 1])
                    piece = ids[start : min(n, end - begin)]
                    raw = piece.tobytes()
                    out.append((doc_id, start, len(piece), zlib.crc32(raw), n, sequence, offset, raw if with_ids else None))
                    start += len(piece)
                    size += len(raw)
                if size > 8_000_000:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    return order.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")

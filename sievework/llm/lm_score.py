"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word unigram base.

The corpus is read once into chunks: the words of some documents, numbered within the chunk by Arrow, with their subword
ids. Counts of a word meet in a part of the words, which its subword ids tell. A chunk sends one row to each part, with its
words of that part, each once, as chunks are summed first; there are as many more parts as there are more chunks, so a part
stays as large, and nothing of the size of the vocabulary of words is broadcast or collected.

The model gives the next subword in two steps: a class, by self-attention over the window added to the logarithm of the
class's share, in the whole training corpus, after the subword before and the class before that; and the subword within its class by its
share after the subword before, or after that one's class where counts are small. The most frequent subwords (``TOP``) are told apart as
histories, the others are one. The ``SINGLE`` most frequent are classes of their own; the others share classes of about
equal mass, apart for subwords that begin a word and those that go on with one. ``score`` is the logarithm of the product over a text's subwords
and its end, and nothing else is mixed in. Windows overlap: each token is scored once, with at least ``OVERLAP`` tokens
before it in its window wherever the document has them. Training windows lie side by side, so that each training token
is a target once; every window of every training document trains in exactly one of the rounds. Tasks train on their own
chunks from common weights, which are averaged after each round. Counts cover all training documents.

Defined cases: a null text is empty; an empty text is the end token alone; very long texts are chunks of their own;
repeated rows are scored each; without training rows all counts are 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import release_memory, stored, table

#: Bytes of text in a chunk, about, and words of a chunk that are opened at a time.
CHUNK, OPEN = 12_000_000, 150_000
WINDOW, OVERLAP, WIDTH, CLASSES, SINGLE, TOP = 32, 6, 16, 64, 52, 1024
ROUNDS, BATCH, RATE = 3, 96, 0.003
#: Numbers of a table that are sent as one, and chunks for each of the parts in which words meet.
PART, CHUNKS_A_PART = 1 << 16, 4
#: Of the attention's scores.
SCALE = np.float32(WIDTH**-0.5)
#: Rows of a long, narrow product that are multiplied at a time.
ROWS = 512
CHUNK_ROW = "chunk long, doc_ids array<long>, held_out array<boolean>, ends array<int>, words string, counts binary, seq binary, sub binary, sub_ends binary, id_counts binary"


def squeeze(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


@lru_cache(maxsize=2)
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    """A sentencepiece model with byte fallback; a word's first piece carries the mark of a word's begin."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 0


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, number of each word, distinct words) of texts; A-Z in lower case."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty part
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    coded = flat.filter(full).dictionary_encode()
    return before[ends] - before[ends - sizes], coded.indices.to_numpy(), coded.dictionary


def chunks(docs: DataFrame, model_path: str, folds: int) -> DataFrame:
    """Rows of CHUNK_ROW: the documents of a chunk as numbers of its words, the end token as number of words.

    ``words`` has spaces between; ``counts`` and ``id_counts`` are how often its words and all subword ids stand in its training documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = pieces(model_path), TaskContext.get().partitionId() << 33
        end_id = own.get_piece_size()

        def close(ids: list, texts: list[pa.Array]) -> pa.RecordBatch:
            nonlocal chunk
            sizes, number, unique = numbered(pa.concat_arrays(texts))  # whole arrays: Arrow lowers parts of large ones wrongly
            ends = np.cumsum(sizes + 1)
            seq = np.full(int(ends[-1]), len(unique), np.uint32)
            inside = np.ones(len(seq), bool)
            inside[ends - 1] = False
            seq[inside] = number
            out = [held_out(i, folds) for i in ids]
            counts = np.bincount(seq[~np.repeat(out, sizes + 1)], minlength=len(unique) + 1)[: len(unique)]
            sub = [*(own.encode(unique.to_numpy(zero_copy_only=False).tolist(), num_threads=1) if len(unique) else []), [end_id]]
            sub_ends = np.cumsum(np.fromiter(map(len, sub), np.int64, len(sub)))
            sub_flat = np.fromiter(chain.from_iterable(sub), np.uint16, int(sub_ends[-1]))
            often = np.append(counts, len(out) - sum(out))
            id_counts = np.bincount(sub_flat, np.repeat(often, np.diff(sub_ends, prepend=0)), minlength=end_id + 1)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            blobs = [pa.array([squeeze(x, kind)], pa.binary()) for x, kind in ((counts, "<u4"), (seq, "<u4"), (sub_flat, "<u2"), (sub_ends, "<u4"), (id_counts, "<u4"))]
            joined = pc.binary_join(one(unique.cast(pa.string()), pa.string()), " ")
            columns = [pa.array([chunk], pa.int64()), one(ids, pa.int64()), one(out, pa.bool_()), one(ends, pa.int32()), joined, *blobs]
            chunk += 1
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "held_out", "ends", "words", "counts", "seq", "sub", "sub_ends", "id_counts"])

        ids, texts, size = [], [], 0
        for b in batches:
            all_texts, first = b.column(1).fill_null(""), 0
            ends = np.cumsum(pc.binary_length(all_texts).to_numpy().astype(np.int64))
            while first < b.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = min(b.num_rows, int(np.searchsorted(ends, before + CHUNK - size)) + 1)
                ids += b.column(0).slice(first, last - first).to_pylist()
                texts.append(all_texts.slice(first, last - first))
                size += int(ends[last - 1]) - before
                first = last
                if size >= CHUNK:
                    yield close(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield close(ids, texts)
        del texts
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK_ROW)


class Chunk:
    """Subword ids of some documents of a chunk, one after the other, and where each ends."""

    def __init__(self, ends: np.ndarray, seq: np.ndarray, sub: np.ndarray, start: np.ndarray, size: np.ndarray):
        """start, size: of each word's ids in sub."""
        seq = seq.astype(np.intp)  # what numpy takes without a copy
        sizes = size.take(seq)
        after = np.cumsum(sizes)
        shift = start.take(seq)
        shift -= after
        shift += sizes
        at = np.repeat(shift, sizes)
        at += np.arange(len(at))
        self.ids = sub.take(at)
        self.id_ends = after[ends - 1]


def opened(ends: np.ndarray, seq: bytes, sub: bytes, sub_ends: bytes, mine: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, Chunk]]:
    """(first, last, numbers of the words, ids) of as many documents at a time as keep the arrays small; of those marked in ``mine``, if given."""
    whole, sub, stop = unsqueeze(seq, "<u4"), unsqueeze(sub, "<u2").astype(np.int32), unsqueeze(sub_ends, "<u4").astype(np.int64)
    size = np.diff(stop, prepend=0)
    start, first = stop - size, 0
    if mine is not None:
        sizes = np.diff(ends, prepend=0)
        whole, ends = whole[np.repeat(mine, sizes)], np.cumsum(sizes[mine])
    while first < len(ends):
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + OPEN)))
        own = whole[begin : ends[last - 1]]
        yield first, last, own, Chunk(ends[first:last] - begin, own, sub, start, size)
        first = last


TRAIN = ("held_out", "ends", "seq", "sub", "sub_ends")


def train_parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ends) of documents that aren't held out, of rows (held_out, ends, seq, sub, sub_ends)."""
    for out, ends, seq, sub, sub_ends in zip(*batch.columns, strict=True):
        for _, _, _, c in opened(np.asarray(ends.values).astype(np.int64), seq.as_py(), sub.as_py(), sub_ends.as_py(), ~np.asarray(out.values)):
            yield c.ids, c.id_ends


def windows(ends: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window's first place, document's end, first place scored, number within its document) of every window."""
    begins = np.concatenate([[0], ends[:-1]])
    n = 1 + np.maximum(0, -(-(ends - begins - WINDOW) // (WINDOW - overlap)))
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(begins, n) + k * (WINDOW - overlap)
    return start, np.repeat(ends, n), start + np.where(k > 0, overlap, 0), k


def inputs(y: np.ndarray, ends: np.ndarray, start: int, back: int = 1) -> np.ndarray:
    """What stands so many places before each token; ``start`` before the begin of a document."""
    x = np.concatenate([np.full(back, start, y.dtype), y[:-back]])[: len(y)]
    begins = np.concatenate([[0], ends[:-1]])
    for k in range(back):
        at = begins + k
        x[at[at < ends]] = start
    return x


class Attention:
    """One causal self-attention layer over a window, added to the trigrams; weights are one flat vector."""

    SHAPES = {"E": (TOP + 2, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "U": (WIDTH, CLASSES)}
    MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
    PLACES = np.arange((TOP + 2) * WIDTH).reshape(TOP + 2, WIDTH)

    def __init__(self, trigrams: np.ndarray, flat: np.ndarray | None = None):
        """trigrams: ln P(class | class two places before, subword before), by (TOP + 2) * the first + the second."""
        self.trigrams = trigrams.astype(np.float32)
        self.flat = self.start() if flat is None else flat.astype(np.float32)
        at = 0
        for k, s in self.SHAPES.items():
            setattr(self, k, self.flat[at : at + s[0] * s[1]].reshape(s))
            at += s[0] * s[1]

    @classmethod
    def start(cls) -> np.ndarray:
        rnd = np.random.default_rng(5)
        scale = {"E": 0.5, "P": 0.2, "U": 0.02}
        return np.concatenate([(rnd.standard_normal(s) * scale.get(k, WIDTH**-0.5)).ravel() for k, s in cls.SHAPES.items()]).astype(np.float32)

    def forward(self, x: np.ndarray, before: np.ndarray, skip: int = 0) -> tuple:
        """Arrays of windows: x the numbers of the subwords before each place, ``before`` the classes two places before.

        Queries go through both of Q and K, and what the places' inputs are mixed to goes through V, so the inputs themselves
        are keys and values. The attention's weights stay without their sums, by which the mixed inputs are divided. The first
        ``skip`` places are looked at, but get no logits.
        """
        n, w = x.shape
        e = self.E.take(x, 0)
        e += self.P
        own, top = w - skip, e
        if skip:
            top, x, before = np.ascontiguousarray(e[:, skip:]), x[:, skip:], before[:, skip:]
        top = top.reshape(n * own, WIDTH)
        q = (top @ (self.Q @ self.K.T * SCALE)).reshape(n, own, WIDTH)
        keys = np.ascontiguousarray(e.transpose(0, 2, 1))
        a = q @ keys
        if a.max() > 60:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= self.MASK[skip:w, :w]
        over = np.float32(1) / (a @ np.ones(w, np.float32))[:, :, None]
        z = a @ e
        z *= over
        h = z.reshape(n * own, WIDTH) @ self.V
        h += top
        logits = h @ self.U
        logits += self.trigrams.take((before * (TOP + 2) + x).ravel(), 0)
        if logits.max() > 60:
            logits -= logits.max(1, keepdims=True)
        return e, keys, q, a, over, z, h, logits

    ONES = np.ones(CLASSES, np.float32)

    def log_p(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, skip: int = 0) -> np.ndarray:
        """ln P of each class y, but for the first ``skip`` places."""
        logits, y = self.forward(x, before, skip)[-1], y[:, skip:]
        told = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + y.ravel())
        return (told - np.log(np.exp(logits, out=logits) @ self.ONES)).reshape(y.shape)

    def gradient(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Of the mean of -ln P over valid places."""
        n, w = x.shape
        e, keys, q, a, over, z, h, d = self.forward(x, before)
        e2, z2 = e.reshape(n * w, WIDTH), z.reshape(n * w, WIDTH)
        weight = valid.ravel().astype(np.float32) / np.float32(max(1, valid.sum()))
        np.exp(d, out=d)
        sums = d @ self.ONES
        told, flat_d = np.arange(0, d.size, CLASSES) + y.ravel(), d.reshape(-1)
        flat_d[told] = flat_d.take(told) - sums
        share = (weight / sums)[:, None]  # of which d lacks the factor
        h *= share
        u = sum(h[i : i + ROWS].T @ d[i : i + ROWS] for i in range(0, n * w, ROWS))
        dh = d @ self.U.T
        dh *= share
        dz = (dh @ self.V.T).reshape(n, w, WIDTH)
        dz *= over
        mean = ((dz * z).reshape(n * w, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(n, w, 1)
        ds = dz @ keys
        ds -= mean
        ds *= a
        dq = (ds @ e).reshape(n * w, WIDTH)
        de = dq @ (self.K @ self.Q.T * SCALE)
        de += dh
        de += (ds.transpose(0, 2, 1) @ q).reshape(n * w, WIDTH)
        de += (a.transpose(0, 2, 1) @ dz).reshape(n * w, WIDTH)
        qk = e2.T @ dq * SCALE
        grad_e = np.bincount(self.PLACES.take(x.ravel(), 0).ravel(), de.ravel(), self.PLACES.size).astype(np.float32)
        grads = (grad_e, de.reshape(n, w, WIDTH).sum(0), qk @ self.K, qk.T @ self.Q, z2.T @ dh, u)
        return np.concatenate([g.ravel() for g in grads])


def _placed(at: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    return [x.take(at, mode="clip") for x in arrays]


def in_round(k: np.ndarray, phase: int) -> np.ndarray:
    """The windows that train in a round, from their numbers within their documents; each document begins at another round."""
    return np.flatnonzero((k + np.cumsum(k == 0)) % ROUNDS == phase)


class Adam:
    def __init__(self, model: Attention):
        self.own = Attention(model.trigrams, model.flat.copy())
        self.m, self.s, self.step, self.seen = np.zeros_like(model.flat), np.zeros_like(model.flat), 0, 0

    def train(self, y: np.ndarray, x: np.ndarray, before: np.ndarray, ends: np.ndarray, phase: int) -> None:
        """Over the windows of a round."""
        start, stop, _, k = windows(ends, 0)
        mine = in_round(k, phase)
        mine = mine[np.random.default_rng(phase).permutation(len(mine))]
        for i in range(0, len(mine), BATCH):
            part = mine[i : i + BATCH]
            at = start[part][:, None] + np.arange(WINDOW)
            xs, bs, ys = _placed(at, x, before, y)
            g = self.own.gradient(xs, bs, ys, at < stop[part][:, None])
            self.step += 1
            self.m += 0.1 * (g - self.m)
            self.s += 0.01 * (g * g - self.s)
            self.own.flat -= RATE * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.s / (1 - 0.99**self.step)) + 1e-8)
            self.seen += len(part)


def score_classes(model: Attention, y: np.ndarray, x: np.ndarray, before: np.ndarray, ends: np.ndarray, together: int = 32) -> np.ndarray:
    """ln P of every token's class, each from the one window that scores it."""
    out = np.zeros(len(y))
    start, stop, first, _ = windows(ends)
    for skip in (0, OVERLAP):  # what an earlier window has scored is only looked at
        for whole in (True, False):  # windows that a document fills need no masks
            kind = np.flatnonzero((first - start == skip) & ((start + WINDOW <= stop) == whole))
            for i in range(0, len(kind), together):
                part = kind[i : i + together]
                at = start[part][:, None] + np.arange(WINDOW)
                xs, bs, ys = _placed(at, x, before, y)
                scored, ln = at[:, skip:], model.log_p(xs, bs, ys, skip)
                if whole:
                    out[scored] = ln
                else:
                    mine = scored < stop[part][:, None]
                    out[scored[mine]] = ln[mine]
    return out


def _collected(places: DataFrame, size: int) -> np.ndarray:
    """The sum of (i, v) by place; at most ``size`` rows, which is fixed."""
    rows = places.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _counted(read: DataFrame, add, size: int) -> np.ndarray:
    """The sum of what add(batch, total) adds to ``size`` numbers over all chunks; tasks send parts of them, packed, that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            add(b, total)
        for k in range(0, size, PART):
            if total[k : k + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([squeeze(total[k : k + PART], "<i8")], pa.binary())], ["k", "x"])
        del total
        release_memory()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of k."""
        key, total = None, None
        for b in batches:
            for k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == key:
                    total += unsqueeze(x, "<i8")
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([squeeze(total, "<i8")], pa.binary())], ["k", "x"])
                key, total = k, unsqueeze(x, "<i8").copy()
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([squeeze(total, "<i8")], pa.binary())], ["k", "x"])

    kind, out = "k long, x binary", np.zeros(size)
    rows = read.mapInArrow(run, kind).repartition("k").sortWithinPartitions("k").mapInArrow(summed, kind).toArrow()
    for k, x in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        out[k : k + PART] = unsqueeze(x, "<i8")
    return out


def add_ids(batch: pa.RecordBatch, total: np.ndarray) -> None:
    """How often each id stands in a chunk's training documents; rows (id_counts)."""
    for blob in batch.column(0):
        total += unsqueeze(blob.as_py(), "<u4")


def classes(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each id; those that begin words come first, the end token (the last id) as class 0."""
    end = len(counts) - 1
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = np.concatenate([[end], order[order != end]])
    single, rest, groups = order[:SINGLE], order[SINGLE:], []
    for kind in (True, False):
        ids = rest[begins[rest] == kind]
        share = np.cumsum(counts[ids] + 0.5)
        bins = np.minimum((share / share[-1] * ((CLASSES - SINGLE) // 2)).astype(int), (CLASSES - SINGLE) // 2 - 1)
        groups.append([*([i] for i in single if begins[i] == kind), *(ids[bins == k] for k in range((CLASSES - SINGLE) // 2))])
    of = np.empty(len(counts), np.int32)
    for k, ids in enumerate(groups[0] + groups[1]):
        of[ids] = k
    return of


class Tables:
    """What the counts tell: the class and the number of each id, and chances of ids within their classes."""

    def __init__(self, of: np.ndarray, number: np.ndarray, within: np.ndarray, share: np.ndarray, rest: np.ndarray):
        """within: P(id | its class, class before); share: of an id (by number) after another, within its class; rest: what is left to within, by number and class."""
        self.of, self.number, self.within, self.share, self.rest = of, number, within, share, rest

    def sequences(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, number of the id before, class two places before) of each id."""
        y = self.of[ids]
        return y, inputs(self.number[ids], ends, TOP + 1), inputs(y, ends, CLASSES, 2)

    def ln_within(self, ids: np.ndarray, y: np.ndarray, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = x.astype(np.intp)
        p = self.rest.take(x * CLASSES + y)
        p *= self.within.take(inputs(y, ends, CLASSES).astype(np.intp) * self.within.shape[1] + ids)
        p += self.share.take(x * (TOP + 1) + self.number.take(ids))
        return np.log(p)


class Model:
    def __init__(self, attention: Attention, tables: Tables):
        self.attention, self.tables = attention, tables

    def scores(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """ln P of every id."""
        y, x, before = self.tables.sequences(ids, ends)
        return score_classes(self.attention, y, x, before, ends) + self.tables.ln_within(ids, y, x, ends)


def learn_tables(read: DataFrame, begins: np.ndarray) -> tuple[Tables, np.ndarray]:
    """(tables, trigrams) of all training documents; the driver gets arrays of fixed sizes."""
    n_ids, n, top = len(begins), CLASSES + 1, TOP + 2
    counts = _counted(read.select("id_counts"), add_ids, n_ids)
    of = classes(counts, begins)
    number = np.full(n_ids, TOP, np.int32)  # the others
    number[np.lexsort((np.arange(n_ids), -counts))[:TOP]] = np.arange(TOP)
    smooth = counts + 0.5
    own = smooth / np.bincount(of, smooth, CLASSES)[of]
    at = np.cumsum([0, n * n_ids, n * top * CLASSES, top * TOP])

    def add_seen(batch: pa.RecordBatch, total: np.ndarray) -> None:
        """Ids after classes, classes after class and number, and numbers after numbers, in one row of numbers."""
        for ids, ends in train_parts(batch):
            y, m = of[ids], number[ids]
            x, before, told = inputs(m, ends, TOP + 1), inputs(y, ends, CLASSES, 2), m < TOP
            for k, places in enumerate((inputs(y, ends, CLASSES) * np.int32(n_ids) + ids, (before * top + x) * CLASSES + y, (x * TOP + m)[told])):
                np.add.at(total, at[k] + places, 1)

    follow, three, next_ = (x.reshape(s) for x, s in zip(np.split(_counted(read.select(*TRAIN), add_seen, int(at[-1])), at[1:-1]), ((n, n_ids), (n, top, CLASSES), (top, TOP)), strict=True))
    pairs = np.stack([np.bincount(of, row, CLASSES) for row in follow])
    within = ((follow + 10 * own) / (pairs[:, of] + 10)).astype(np.float32)
    listed = np.flatnonzero(number < TOP)
    class_of = np.empty(TOP, np.int64)  # of each number
    class_of[number[listed]] = of[listed]
    if len(listed) < TOP:
        class_of[len(listed) :] = 0
    inside = np.stack([np.bincount(class_of, row, CLASSES) for row in next_])
    share = np.zeros((top, TOP + 1), np.float32)
    share[:, :TOP] = next_ / (inside[:, class_of] + 20)
    rest = (20 / (inside + 20)).astype(np.float32)
    single = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    two = three.sum(0)
    two = (two + 20 * single) / (two.sum(1, keepdims=True) + 20)
    trigrams = np.log((three + 20 * two[None]) / (three.sum(2, keepdims=True) + 20)).reshape(n * top, CLASSES).astype(np.float32)
    return Tables(of, number, within, share, rest), trigrams


def train(read: DataFrame, begins: np.ndarray) -> Model:
    """The model of the training documents of chunks."""
    tables, trigrams = learn_tables(read, begins)
    attention, narrow = Attention(trigrams), Tables(tables.of, tables.number, *[np.zeros((0, 0))] * 3)
    for phase in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], attention=attention, phase=phase) -> Iterator[pa.RecordBatch]:
            task = Adam(attention)
            for b in batches:
                for ids, ends in train_parts(b):
                    task.train(*narrow.sequences(ids, ends), ends, phase)
            if task.seen:
                yield pa.RecordBatch.from_arrays([pa.array([np.append(task.seen * task.own.flat.astype(np.float64), task.seen)], pa.list_(pa.float64()))], ["x"])
            release_memory()

        sums = _collected(read.select(*TRAIN).mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "v")), len(attention.flat) + 1)
        if sums[-1]:
            attention = Attention(trigrams, sums[:-1] / sums[-1])
    return Model(attention, tables)


def trained(read: DataFrame, model_path: str) -> Model:
    own = pieces(model_path)
    return train(read, np.array([*(own.id_to_piece(i).startswith("▁") for i in range(own.get_piece_size())), True]))


def word_parts(sub: np.ndarray, ends: np.ndarray, parts: int) -> np.ndarray:
    """The part of each word, which its subword ids tell."""
    x = sub.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x * x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (x << np.uint64(32)))])
    h = np.diff(sums[np.concatenate([[0], ends])])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def dealt_words(read: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, words, counts, pos): a chunk's words of a part with spaces between, their training counts and their places, as numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, counts, sub, sub_ends in zip(*b.columns, strict=True):
                counts = unsqueeze(counts.as_py(), "<u4")
                if not len(counts):
                    continue
                words = pc.split_pattern(pa.array([words.as_py()], pa.string()), " ").flatten()
                of = word_parts(unsqueeze(sub.as_py(), "<u2"), unsqueeze(sub_ends.as_py(), "<u4"), parts)[: len(words)]
                pos = np.argsort(of, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=parts))])
                some = np.flatnonzero(np.diff(ends))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(pos))), " ")
                blobs = [pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(x.astype("<u4"))]) for x in (counts[pos], pos)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), chunk.as_py())), *(x.take(pa.array(some)) for x in (joined, *blobs))], ["part", "chunk", "words", "counts", "pos"])

    return read.select("chunk", "words", "counts", "sub", "sub_ends").mapInArrow(run, "part long, chunk long, words string, counts binary, pos binary")


def word_counts(read: DataFrame) -> DataFrame:
    """(chunk, c, n, v): training counts of all words of a chunk, in their order; n and v are the sum and number of those that this row tells for all."""
    parts = -(-read.count() // CHUNKS_A_PART)
    if not parts:
        return read.sparkSession.createDataFrame([], "chunk long, c binary, n long, v long")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows in order of the first column, those of one value at a time."""
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            _, chunk, words, counts, pos = zip(*rows, strict=True)
            coded = pc.split_pattern(pa.array(words, pa.large_string()), " ").flatten().dictionary_encode()
            at = coded.indices.to_numpy()
            total = np.bincount(at, np.frombuffer(b"".join(counts), "<u4"), len(coded.dictionary)).astype("<i8")
            known, ends = total[total > 0], np.cumsum([len(x) // 4 for x in pos])
            c = [x.tobytes() for x in np.split(total[at], ends[:-1])]
            told = [[x, *[0] * (len(rows) - 1)] for x in (int(known.sum()), len(known))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((chunk, pa.int64()), (c, pa.binary()), (pos, pa.binary()), (told[0], pa.int64()), (told[1], pa.int64()))], ["chunk", "c", "pos", "n", "v"])
        release_memory()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            chunk, c, pos, n, v = zip(*rows, strict=True)
            c, pos = np.frombuffer(b"".join(c), "<i8"), np.frombuffer(b"".join(pos), "<u4")
            whole = np.empty(len(c), np.int64)
            whole[pos] = c
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((chunk[0], pa.int64()), (squeeze(whole, "<i8"), pa.binary()), (sum(n), pa.int64()), (sum(v), pa.int64()))], ["chunk", "c", "n", "v"])

    met = dealt_words(read, parts).repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(counted, "chunk long, c binary, pos binary, n long, v long")
    return met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gathered, "chunk long, c binary, n long, v long")


def scores(docs: DataFrame, model_path: str, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    read = stored(chunks(docs, model_path, folds), "chunks")
    model = trained(read, model_path)
    of_chunk = stored(word_counts(read), "counts")
    train_docs = read.select(F.explode("held_out").alias("h")).filter("not h").count()
    n, v = of_chunk.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + train_docs, v + (train_docs > 0)
    both = read.select("chunk", "doc_ids", "held_out", "ends", "seq", "sub", "sub_ends").join(of_chunk.select("chunk", "c"), "chunk", "left").drop("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for b in batches:
            for doc_ids, out, ends, seq, sub, sub_ends, c in zip(*b.columns, strict=True):
                known = np.append(unsqueeze(c.as_py(), "<i8") if c.is_valid else np.zeros(0, np.int64), train_docs)
                ln_base, seen = np.log((known + 0.1) / (n + 0.1 * (v + 1))), (known > 0).astype(np.int64)
                all_ends = np.asarray(ends.values).astype(np.int64)
                for first, last, words, k in opened(all_ends, seq.as_py(), sub.as_py(), sub_ends.as_py()):
                    sizes = np.diff(all_ends[first:last], prepend=all_ends[first - 1] if first else 0)
                    begins, id_begins = np.cumsum(sizes) - sizes, np.concatenate([[0], k.id_ends[:-1]])
                    ln = model.scores(k.ids, k.id_ends)
                    columns = [doc_ids.values.slice(first, last - first), out.values.slice(first, last - first), sizes, np.add.reduceat(seen[words], begins), np.full(len(sizes), n), np.add.reduceat(ln_base[words], begins) / np.log(10), np.add.reduceat(ln, id_begins) / np.log(10)]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
        release_memory()

    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

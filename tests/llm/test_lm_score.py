import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from sievework.llm import lm_score as L
from sievework.llm.common import stored, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, chunk int"


def some_model(rnd):
    model = L.Attention(np.log(rnd.dirichlet(np.ones(L.CLASSES), (L.CLASSES + 1) * (L.TOP + 2))))
    model.flat += 0.1 * rnd.standard_normal(len(model.flat)).astype(np.float32)
    return model


def plain_log_p(model, window, before, y):
    """ln P of class y after a window of numbers, by loops over places in double precision."""
    f = {k: getattr(model, k).astype(float) for k in model.SHAPES}
    e = [f["E"][c] + f["P"][i] for i, c in enumerate(window)]
    q = e[-1] @ f["Q"]
    weight = [math.exp(float(q @ (x @ f["K"])) / math.sqrt(L.WIDTH)) for x in e]
    h = e[-1] + sum(w * (x @ f["V"]) for w, x in zip(weight, e, strict=True)) / sum(weight)
    logits = h @ f["U"] + model.trigrams[before * (L.TOP + 2) + window[-1]].astype(float)
    return float(logits[y] - np.log(np.exp(logits).sum()))


def plain_scores(model, y, numbers):
    """ln P of every class of a document: the token at t is scored in the window that holds OVERLAP tokens before it."""
    out = []
    for t in range(len(y)):
        k = 0 if t < L.WINDOW else (t - L.OVERLAP) // (L.WINDOW - L.OVERLAP)
        x = [L.TOP + 1, *numbers]
        begin = k * (L.WINDOW - L.OVERLAP)
        out.append(plain_log_p(model, x[begin : t + 1], y[t - 2] if t > 1 else L.CLASSES, y[t]))
    return out


def test_gradient():
    rnd = np.random.default_rng(1)
    model = some_model(rnd)
    x, before, y = rnd.integers(0, L.CLASSES, (3, 3, L.WINDOW))
    x[:, ::5] += 900
    valid = rnd.random((3, L.WINDOW)) < 0.8
    g = model.gradient(x, before, y, valid)
    loss = lambda f: -(L.Attention(model.trigrams, f).log_p(x, before, y).astype(float) * valid).sum() / valid.sum()
    at, ends = 0, {}
    for k, s in L.Attention.SHAPES.items():
        ends[k] = (at, at := at + s[0] * s[1])
    for a, z in ends.values():
        for i in a + np.argsort(-np.abs(g[a:z]))[:3]:
            up, down = model.flat.copy(), model.flat.copy()
            up[i] += 0.02
            down[i] -= 0.02
            assert abs((loss(up) - loss(down)) / 0.04 - g[i]) < 0.05 * abs(g[i]) + 1e-5


def test_windows_score_each_token_once_as_a_plain_loop():
    rnd = np.random.default_rng(2)
    model = some_model(rnd)
    sizes = [1, 2, 31, 32, 33, 57, 56, 130]
    y, m, ends = rnd.integers(0, L.CLASSES, sum(sizes)), rnd.integers(0, L.TOP + 1, sum(sizes)), np.cumsum(sizes)
    got = L.score_classes(model, y, L.inputs(m, ends, L.TOP + 1), L.inputs(y, ends, L.CLASSES, 2), ends, together=3)
    want = [p for end, n in zip(ends, sizes, strict=True) for p in plain_scores(model, y[end - n : end].tolist(), m[end - n : end].tolist())]
    assert np.abs(got - want).max() < 1e-3


def test_base_and_score(spark):
    """All columns against plain loops; the score with the weights that the operator trains."""
    rnd = np.random.default_rng(3)
    lines = [" ".join(rnd.choice(["The", "and", "ÉT", "thonnd", "erea", "x"], rnd.integers(1, 60))) for _ in range(80)] + [None, "", " \n", "new words here!", "a" * 3000, " tabs\tand\x0bmore x "]
    rows = [(i, t, "s", 1) for i, t in enumerate(lines)] + [(4, lines[4], "s", 1), (None, "no id", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = L.scores(df, PATH).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = collections.Counter(w for i, t, *_ in rows if not out(i) for w in [*words(t or ""), None])
    n, v = sum(count.values()), len(count)
    of = {i: [*words(t or ""), None] for i, t, *_ in rows}
    model = L.trained(stored(L.chunks(df, PATH, 10), "chunks"), PATH)
    assert np.abs(model.attention.flat - L.Attention.start()).max() > 0.001
    t = model.tables  # within each class the chances of all ids sum to one, after any history
    for x, c in ((0, 3), (5, 60), (L.TOP, 1), (L.TOP + 1, L.CLASSES)):
        p = t.share[x][t.number] + t.rest[x][t.of] * t.within[c]
        assert np.abs(np.bincount(t.of, p) - 1).max() < 1e-3
    own, end = L.pieces(PATH), L.pieces(PATH).get_piece_size()
    for r in got:
        w = of[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * len(w)
        ids = [i for x in w[:-1] for i in own.encode(x.decode())] + [end]
        if len(ids) < 200:
            t = model.tables
            y, m = [int(t.of[i]) for i in ids], [int(t.number[i]) for i in ids]
            want = sum(plain_scores(model.attention, y, m))
            for k, i in enumerate(ids):
                x, c = (m[k - 1], y[k - 1]) if k else (L.TOP + 1, L.CLASSES)
                want += math.log(t.share[x, m[k]] + t.rest[x, y[k]] * t.within[c, i])
            assert abs(r.score * math.log(10) - want) < 1e-3 * len(ids)
        assert math.isfinite(r.score) and r.score < 0
    assert L.scores(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_no_training_rows(spark):
    i = next(i for i in range(100) if L.held_out(i, 10))
    (r,) = L.scores(spark.createDataFrame([(i, "some words", "", 0)], DOCS), PATH).collect()
    assert (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 3) and math.isfinite(r.base_score) and math.isfinite(r.score)


def test_words_as_python_cuts_them():
    rnd = random.Random(4)
    chars = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "A", "z", "É", "İ", "\x00"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    sizes, number, unique = L.numbered(pa.array(texts))
    unique = unique.to_pylist()
    assert [unique[i].encode() for i in number] == [w for t in texts for w in words(t)] and sizes.tolist() == [len(words(t)) for t in texts]


def test_the_model_is_a_distribution():
    """Over all ids after any history the probabilities sum to one; classes tell words' begins apart."""
    rnd, own = np.random.default_rng(5), L.pieces(PATH)
    n = own.get_piece_size()
    begins = np.array([*(own.id_to_piece(i).startswith("▁") for i in range(n)), True])
    of = L.classes(np.arange(n + 1), begins)
    assert of[n] == 0 and len(np.unique(of)) == L.CLASSES and not set(of[begins]) & set(of[~begins])
    assert all(begins[x[0]] and not begins[x[1:]].any() for x in own.encode(["the", "thndor", "Été!", "日本", "x y", "|"]))
    model = some_model(rnd)
    x, before = rnd.integers(0, L.CLASSES, (2, 1, L.WINDOW))
    total = sum(np.exp(model.log_p(x, before, np.full((1, L.WINDOW), c))) for c in range(L.CLASSES))
    assert np.abs(total - 1).max() < 1e-4


def test_every_window_trains_in_one_round():
    ends = np.cumsum([1, 20, 40, 200, 33, 1500, 7])
    start, stop, _, k = L.windows(ends, 0)
    rounds = [L.in_round(k, r) for r in range(L.ROUNDS)]
    assert sorted(np.concatenate(rounds).tolist()) == list(range(len(k)))
    covered = np.concatenate([np.arange(a, min(a + L.WINDOW, z)) for a, z in zip(start, stop, strict=True)])
    assert covered.tolist() == list(range(ends[-1]))  # each token is a target once
    document = np.cumsum(k == 0)
    assert all(set(document[np.isin(document, np.flatnonzero(np.bincount(document) >= L.ROUNDS))]) <= set(document[r]) for r in rounds)


def test_words_are_counted_in_parts_and_sent_in_bulk(spark):
    """Counts of words over several chunks against a plain count; a chunk sends a row to each part, not one of each word."""
    rnd = random.Random(9)
    vocabulary = ["The", "the", "é", "﻿", " x", "日本", "a\x1cb", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(60))), "", 0) for i in range(200)] + [(200, "", "", 0), (201, None, "", 0)]
    read = stored(L.chunks(spark.createDataFrame(rows, DOCS).repartition(9), PATH, 10), "chunks")
    want = collections.Counter(w.decode() for i, t, *_ in rows if not L.held_out(i, 10) for w in words(t or ""))
    got = {r.chunk: r for r in L.word_counts(read).collect()}
    held = read.select("chunk", "words").collect()
    assert len(held) > 4 and len(got) == len(held)
    for r in held:
        assert L.unsqueeze(got[r.chunk].c, "<i8").tolist() == [want[w] for w in r.words.split(" ")]
    assert sum(r.n for r in got.values()) == sum(want.values()) and sum(r.v for r in got.values()) == len(want)
    dealt = L.dealt_words(read, 3).collect()
    assert len(dealt) <= 3 * len(held) < sum(len(r.words.split(" ")) for r in held)
    parts = collections.defaultdict(set)
    for r in dealt:
        for w in r.words.split(" "):
            parts[w].add(r.part)
    assert all(len(x) == 1 for x in parts.values()) and len(set.union(*parts.values())) == 3
    assert L.word_counts(read.limit(0)).collect() == []
    assert L._counted(read.select("id_counts"), L.add_ids, L.pieces(PATH).get_piece_size() + 1).sum() == sum(L.unsqueeze(r[0], "<u4").sum() for r in read.select("id_counts").collect())


def test_keys_and_values_need_no_products_of_their_own():
    """All places go through the joined weights of queries and keys, and through V once mixed; K meets weights alone."""
    rnd, met = np.random.default_rng(11), []

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *args, out=None, **options):
            if ufunc is np.matmul:
                met.append(max(np.shape(x)[0] for x in args))
            plain = [np.asarray(x) for x in args]
            return getattr(ufunc, method)(*plain, **options) if out is None else getattr(ufunc, method)(*plain, out=out, **options)

    model = some_model(rnd)
    x, before, y = rnd.integers(0, L.CLASSES, (3, 4, L.WINDOW))
    want = model.log_p(x, before, y)
    model.K = model.K.view(Counted)
    assert np.array_equal(model.log_p(x, before, y), want)
    model.gradient(x, before, y, np.ones(x.shape, bool))
    assert met and max(met) == L.WIDTH


def test_training_opens_the_ids_of_training_documents_alone(spark):
    own = L.pieces(PATH)
    rows = [(i, " ".join(f"w{i} x{j}" for j in range(i % 7)), "", 0) for i in range(60)]
    read = stored(L.chunks(spark.createDataFrame(rows, DOCS).repartition(3), PATH, 10), "chunks")
    got = []
    for b in read.select(*L.TRAIN).toArrow().to_batches():
        for ids, ends in L.train_parts(b):
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
    want = [[k for w in words(t) for k in own.encode(w.decode())] + [own.get_piece_size()] for i, t, *_ in rows if not L.held_out(i, 10)]
    assert sorted(got) == sorted(want) and len(want) < 60

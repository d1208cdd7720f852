import math

import numpy as np
import pytest

from sievework.llm import topk as T

ROWS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    good = [(n, i, tuple(math.floor(64 * float(x)) for x in v)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in good if m != n)[:k]  # noqa: B905
            out += [(i, r + 1, j, -x) for r, (x, j, _) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(7, 50), (4096, 8192)])
def test_against_brute_force(spark, blocks):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((400, 40)).astype(np.float32)
    x[50:120] = x[50]
    x[200:300, 20:] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], (40, [1.0] * 40), (7, [9.0]), (None, [1.0] * 40), (1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 40), (1003, [float("inf")]), (1020, []), (-20, [0.5] * 60)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)
    assert sorted(tuple(r) for r in T.top_k(df, 20, 20, *blocks).collect()) == brute(rows, 20, 20)


def test_few_and_none_and_large(spark):
    assert T.top_k(spark.createDataFrame([], ROWS)).collect() == []
    rows = [(0, [3e9, 2.0]), (1, [3e9, 1.0]), (2, [-1e30, 0.0])]
    got = sorted(tuple(r) for r in T.top_k(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)).collect())
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(as_float, 20, 20)]


def test_pruning_is_exact_and_prunes():
    rnd = np.random.default_rng(9)
    for spread in (np.linspace(2, 0.01, 64), np.ones(64)):
        turn = np.linalg.qr(rnd.standard_normal((64, 64)))[0]
        c = np.floor(64 * (rnd.standard_normal((3000, 64)) * spread) @ turn)
        rows, ids = np.arange(3000), rnd.permutation(3000) // 2
        q, axes, told = c[:70], np.linalg.eigh(c.T @ c)[1][:, ::-1].copy(), {}
        least = T.kth_best(q, c[1000:2000], 20)
        got = sorted(zip(*(x.tolist() for x in T.bounded(rows[:70], q, least, rows, ids, T.Columnar(c, axes), 20, told=told)), strict=True))
        want = []
        for n, v in enumerate(q):
            s = sorted((-int(x), j, r) for x, j, r in zip(c @ v, ids.tolist(), rows.tolist(), strict=True) if r != n)[:20]
            want += [(n, -x, j) for x, j, r in s]
        assert sorted((a, s, j) for a, _, j, s in got) == sorted(want)
        share = {cut: n / (70 * 3000) for cut, n in told.items()}
        assert min(share.values()) < 0.1, share

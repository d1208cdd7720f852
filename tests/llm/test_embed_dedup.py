import math

import numpy as np

from sievework.llm import embed_dedup as E

ROWS = "vec_id long, embedding array<float>, label int, kept string, n_links int"


def brute(rows, t=0.93):
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if ok(r) else None for r in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if u[i] is not None and u[j] is not None and a[2] == b[2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= t:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((r[0], n[i], c, r[0] == c))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((500, 32))
    x[100:160] = x[100] + 0.25 * rnd.standard_normal((60, 32))
    x[200:260] = x[200] + 0.2 * rnd.standard_normal((60, 32))
    for i in range(300, 340, 2):
        x[i + 1] = x[i] + 0.2 * rnd.standard_normal(32)
    x[400:430] = x[400]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), i % 3 if not 100 <= i < 430 else 7) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], (900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, [], 1), (905, rows[3][1], None), (906, rows[3][1], None), (907, [1.0], rows[3][2]), (908, [2.0], rows[3][2]), (None, rows[5][1], rows[5][2]), (910, (2 * x[6]).tolist(), 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    got = sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_blocks_count_alike(spark):
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal(16) + 0.3 * rnd.standard_normal((150, 16))
    df = spark.createDataFrame([(0, i, bytearray(v.tobytes()), i % 4 + 1) for i, v in enumerate(x)], "root long, node long, vector binary, copies long")
    one, many = ({r.node: r.n for r in E.counted(df, 0.93, b).collect()} for b in (1024, 20))
    assert one == many and any(one.values())


def test_lists_recall_and_audit(spark):
    """On spread near copies the lists alone reach the bound, and the audit tells the same as brute force."""
    rnd = np.random.default_rng(11)
    x = rnd.standard_normal((4000, 48))
    for i in range(0, 2000, 4):
        x[i + 1 : i + 4] = x[i] + rnd.uniform(0.1, 0.3) * rnd.standard_normal((3, 48))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("r", i, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "root string, node long, vector binary, copies long")
    graph = {tuple(sorted((r.node, r.other))) for r in E.descent(df, 0.93, leaf=64)[0].collect()}
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)), strict=True)}
    assert len(true) > 500 and len(true & graph) >= 0.95 * len(true)
    roots, told = E.linked(df, 0.93)
    (t,) = told.collect()
    assert t.nodes >= 64 and t.recall >= 0.95
    lost = roots.filter("component % 8 = 0")  # half of the components go: the audit sees it
    (t,) = E.audit(df, lost, 0.93, 64).collect()
    assert t.recall < 0.8


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], ROWS)).collect() == []


def bridged(dense, rnd):
    """Two dense groups of distinct vectors, joined by the one link between a member of each, at a lower cosine than any inside."""
    angle = np.arccos(0.94)
    ends = np.zeros((2, 32))
    ends[0, 0], ends[1, :2] = 1, [np.cos(angle), np.sin(angle)]
    out = [ends]
    for way, e in zip((-1, 1), ends, strict=True):
        along = np.array([-e[1], e[0], *np.zeros(30)]) * way
        out.append(e * np.cos(0.2) + along * np.sin(0.2) + 0.004 * rnd.standard_normal((dense, 32)))
    return np.concatenate(out)


def test_a_weak_link_joins_dense_groups(spark):
    x = bridged(500, np.random.default_rng(8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x", 1) for i, v in enumerate(x)]
    got = sorted((tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    assert {r[2] for r in got} == {0} and got == brute(rows)


def test_rare_links_beside_a_dense_group(spark):
    """One dense component doesn't hide what is missing elsewhere: the few links of other labels and groups are all found."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((1500, 16))
    x[:600] = x[0] + 0.1 * rnd.standard_normal((600, 16))
    for i in range(600, 1500, 100):
        x[i + 1] = x[i] * np.sqrt(1 - 0.35**2) + 0.33 * np.linalg.norm(x[i]) * np.eye(16)[i % 16]
    rows = [(i, v.tolist(), 1 + i // 900, "x", 1) for i, v in enumerate(x.astype(np.float32))]
    got = sorted((tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, ROWS), block=256).collect()), key=str)
    want = [r for r in brute(rows)]
    assert got == want and sum(1 for r in want if r[0] >= 600 and r[1]) >= 4

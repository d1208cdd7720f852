import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.functions import text_time as T
from sievework.operators import density, graphs, ordered, selection
from sievework.sources import store


NAMES = {
    "trip_20170902_081530.jpg": "2017-09-02 08:15:30", "20211130235958123.mov": "2021-11-30 23:59:58", "p_202111302359.jpg": "2021-11-30 23:59:00",
    "trip_20170902_990000.jpg": "2017-09-02 12:00:00", "pic-20170902-WA8888.jpg": "2017-09-02 12:00:00", "pic-20170902-WA0031.jpg": "2017-09-02 12:00:31",
    "x 20180230 y 20180331.jpg": "2018-03-31 12:00:00", "Capture 2022-02-03 at 4.05.06 PM.png": "2022-02-03 16:05:06", "Capture 2022-02-03 at 12.05.06 am.png": "2022-02-03 00:05:06", "2017-09-02 07:08.jpg": "2017-09-02 07:08:00",
    "2017_09_02.jpg": "2017-09-02 12:00:00", "20170902 (7).jpg": "2017-09-02 12:00:07", "y/1500000000.jpg": "2017-07-14 02:40:00", "export1500000000250.jpeg": "2017-07-14 02:40:00.250", "20171399 20170902101112.jpg": "2017-09-02 10:11:12",
    "DSC00044.JPG": None, "": None, "9500000000.jpg": None, "18990101.jpg": None, "20170902_24.jpg": "2017-09-02 12:00:24",
}


def test_file_names(spark):
    import datetime as dt

    rows = [(n, dt.datetime.fromisoformat(t).replace(tzinfo=dt.timezone.utc).timestamp() if t else 0.0) for n, t in NAMES.items()] + [(None, 0.0)]
    got = T.captured(spark.createDataFrame(rows, "n string, want double"), "n", "t").collect()
    assert [r for r in got if abs(r.t - r.want) > 1e-3] == []


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    """A path of 5,000 nodes numbered in order, two rings, and a star."""
    rounds = []
    monkeypatch.setattr(graphs, "stored", lambda df, name: (rounds.append(name), store.stored(df, name))[1])
    edges = [(i, i + 1) for i in range(4999)] + [(6000 + i, 6000 + (i + 1) % 50) for i in range(50)] + [(7000, 7001 + i) for i in range(500)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e} | {9999})], "id long")
    got = {r.id: r.root for r in graphs.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i < 5000 else 6000 if i < 7000 else 7000 if i < 9999 else 9999 for i in got}
    assert len(rounds) <= 2 * 20


def test_density_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.uniform(-8, 8, (150, 5)) * [1, 1, 0.3, 0.1, 0.1], rnd.normal(3, 0.2, (80, 5)), np.zeros((20, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    near = np.square(x[:, None] - x[None]).sum(2) <= 1
    for least, block in ((2, 1024), (2, 16), (4, 16)):
        core = near.sum(1) >= least
        label = {}
        for i in np.flatnonzero(core):
            stack = [] if i in label else [i]
            while stack:
                if (k := stack.pop()) not in label:
                    label[k] = i
                    stack += np.flatnonzero(near[k] & core).tolist()
        want = {i: label[i] if core[i] else min((label[k] for k in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))}
        got = {r.id: r.cluster for r in density.clusters(df, 1.0, least, block=block).collect()}
        assert got == want


def test_hamming_and_offsets(spark):
    df = spark.createDataFrame([("00000000000000ff", "0000000000000000"), ("ffffffffffffffff", "0000000000000000"), ("", "0000000000000000"), ("zzzz", "zzzz"), ("ff", "00")], "a string, b string")
    assert [r[0] for r in df.select(S.hamming(F.col("a"), F.col("b"))).collect()] == [8, 64, 64, 64, 64]
    off = spark.createDataFrame([("Z",), (" z ",), ("+05:30",), ("-0800",), ("+14:01",), ("+01:60",), ("x",), (None,)], "s string")
    assert [r[0] for r in off.select(T.exif_offset_minutes(F.col("s"))).collect()] == [0, 0, 330, -480, None, None, None, None]


def test_gap_sessions_keep_the_equal_gap(spark):
    rnd = random.Random(1)
    times = sorted({round(rnd.uniform(0, 300_000), 0) for _ in range(300)} | {1.0, 31.0, 61.5})
    got = {r.id: r.session for r in ordered.gap_sessions(spark.createDataFrame(list(enumerate(times)), "id long, t double"), "t", 30, "id", 5000).collect()}
    want, n = {}, 0
    for i, t in enumerate(times):
        n += i == 0 or t - times[i - 1] > 30
        want[i] = n
    assert got == want


def test_greedy_and_components_and_density(spark):
    rnd = random.Random(2)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(55)}
    items = spark.createDataFrame([(i, (i * 37) % 60) for i in range(60)], "id long, rank long")
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    kept = []
    for i in sorted(range(60), key=lambda i: (i * 37) % 60):
        if not any(tuple(sorted((i, k))) in pairs for k in kept):
            kept.append(i)
    assert {r.id for r in graphs.greedy_kept(items, edges).filter("kept").collect()} == set(kept)
    root = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.root for r in graphs.connected(items, edges).collect()} == dict(enumerate(root))
    for least in (2, 3):
        near = {i: {i} | {x for p in pairs if i in p for x in p} for i in range(60)}
        core, label = {i for i in near if len(near[i]) >= least}, {}
        for i in sorted(core):
            if i not in label:
                stack = [i]
                while stack:
                    x = stack.pop()
                    if x not in label:
                        label[x] = i
                        stack += near[x] & core
        want = {i: label[i] if i in core else min((label[x] for x in near[i] & core), default=-1) for i in near}
        assert {r.id: r.cluster for r in graphs.dbscan(items, edges, least).collect()} == want


def test_upsert_and_new_rows(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path string, n int, s string")
    new = spark.createDataFrame([("b", None), ("c", 3)], "path string, n int")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 3, None)]
    seen = spark.createDataFrame([("a", "h" * 64, "m" * 32), ("b", "h" * 64, "m" * 32), ("c", "h" * 64, "m" * 32)], "path string, file_hash string, file_md5 string")
    cached = spark.createDataFrame([("a", "h" * 64), ("b", "m" * 32)], "path string, file_hash string")
    assert [r.path for r in store.new_rows(seen, cached).collect()] == ["c"]


def records(n, **more):
    rnd = np.random.default_rng(4)
    base = {"file_size": 500_000, "quality_pass": 1, "is_duplicate": 0, "is_private": 0, "cluster_id": 0, "person_id": -1, "is_frequent": 0, "blur_score": 100.0}
    return [{"path": f"/p/{i:03}", "score": float(rnd.random()), "timestamp": 1e9 + 4000.0 * i, **base, **{k: v(i) if callable(v) else v for k, v in more.items()}} for i in range(n)]


def test_selection(spark):
    def pick(rows, **rules):
        return [r.path for r in selection.select(spark.createDataFrame(rows), selection.Rules(**rules)).orderBy("pick").collect()]

    assert len(pick(records(20, cluster_id=lambda i: i), percentage=0.15)) == 3
    assert len(pick(records(3, cluster_id=lambda i: i), percentage=0.01)) == 1
    blurred = records(10, cluster_id=lambda i: i, blur_score=lambda i: 10.0 if i % 2 else 100.0)
    assert all(int(p[-1]) % 2 == 0 for p in pick(blurred, percentage=1.0))
    close = records(3, timestamp=lambda i: 1e9 + 10 * i, cluster_id=-1)
    assert len(pick(close, percentage=1.0)) == 1
    assert len(pick(records(30, cluster_id=lambda i: i, timestamp=lambda i: 1e9 + 90_000.0 * i), max_bytes=1_600_000)) == 3
    with pytest.raises(ValueError):
        selection.Rules(buckets={"people": -1.0, "aesthetic": 2.0}).shares()

import numpy as np
import xxhash

from sievework.llm import simhash as S

DOCS = "doc_id long, text string, fp string, score double"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fp, most=2):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    vocabulary = ["Alpha", "beé", "c", "dd", "e,", "FF", "g.", "Ét", "i", "jj"]
    texts = [" ".join(rnd.choice(vocabulary, rnd.integers(1, 700))) for _ in range(60)]
    texts += [t + " x" for t in texts[:30]] + texts[:10] + ["", None, " \t\n", "a", "A", "a b", "a b", " ".join(["w"] * 100_000), " ".join(["w"] * 99_999)]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fp = {i: fingerprint(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == groups(fp)


def test_groups_of_any_limit_link_alike(spark):
    rnd = np.random.default_rng(5)
    base = [int(x) for x in rnd.integers(0, 2**63, 12)]
    fps = {b ^ (1 << int(rnd.integers(64))) ^ (1 << int(rnd.integers(64))) for b in base for _ in range(60)}
    fps = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = groups({x: x % 2**64 for x in fps})
    for limit in (20, 200, 8192):
        root = {r.node: r.root for r in S.components(S.link_forest(df, 2, limit)).collect()}
        got = {}
        for x in fps:
            got.setdefault(root.get(x, x), set()).add(x)
        expect = {}
        for x, r in want.items():
            expect.setdefault(r, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_index_finds_all_pairs():
    rnd = np.random.default_rng(1)
    fp = np.unique(np.concatenate([rnd.integers(0, 2**63, 900).astype(np.uint64), (np.uint64(77) ^ (np.uint64(1) << rnd.integers(0, 64, 400).astype(np.uint64)))]))
    index = S.GrayIndex(fp)
    got = {tuple(sorted((int(index.fp[i]), int(index.fp[j])))) for a, b in index.near(2) for i, j in zip(a, b, strict=True)}
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fp) for b in fp[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 2}
    assert got == want
    split = index.fp[::2]
    got = {(int(split[q]), int(index.fp[p])) for a, b in index.near(2, split) for q, p in zip(a, b, strict=True)}
    assert got == {(int(a), int(b)) for a in split for b in fp if (int(a) ^ int(b)).bit_count() <= 2}


def test_whole_groups_are_pruned(spark):
    """On ordinary fingerprints, both levels of the index leave most groups unseen."""
    rnd = np.random.default_rng(2)
    fp = np.unique(rnd.integers(0, 2**64, 5000, dtype=np.uint64))
    told = {}
    list(S.GrayIndex(fp).near(2, told=told))
    groups_ = -(-len(fp) // S.FANOUT)
    assert told["pruned"] > 0.6 * told["met"] and told["met"] < 0.5 * len(fp) * (groups_ + groups_ // S.FANOUT)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    (l0, none), (l1, pairs) = S.surviving(df, 2, 500)
    assert (l0, l1) == (0, 1) and none.isEmpty()
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(a, b) for a in range(64) for b in range(a, 64) if (a ^ b).bit_count() <= 2}


def test_empty_table_and_repeated_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = S.near_duplicates(spark.createDataFrame([(5, "a b c d", "", 0.0), (5, "a b c d", "", 0.0), (None, "q r s t", "", 0.0)], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5)]


def test_turned_orders_link_alike_with_few_copies(spark):
    """In one order every fingerprint goes to 42 nodes here; in turned ones once to each order, however many there are."""
    rnd = np.random.default_rng(7)
    fps = {int(x) for x in rnd.integers(0, 2**64, 9000, np.uint64)}
    for x in list(fps)[:60]:
        for _ in range(4):
            y = x
            for bit in rnd.integers(0, 64, 3):
                y ^= 1 << int(bit)
            fps.add(y)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in sorted(fps)], "fp long")
    want, got = ({}, {})
    for out, turns in ((want, 1), (got, 4)):
        for r in S.components(S.link_forest(df, 3, turns=turns)).collect():
            out.setdefault(r.root, set()).add(r.node)
    assert len(want) >= 60 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert S.grouped(df, 3, 8192).count() > 40 * len(fps)
    assert S.grouped(df, 3, 8192, 4).count() == 4 * len(fps)
    for limit in (1, 3):  # nodes over the limit go down in pairs
        own = {}
        for r in S.components(S.link_forest(df, 3, limit, 4)).collect():
            own.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, own.values())) == sorted(map(sorted, want.values()))


def test_turned_orders_on_equal_first_bits_and_none(spark):
    """All fingerprints in few nodes, those of one part; and no fingerprint at all."""
    rnd = np.random.default_rng(8)
    fps = sorted({int(x) << 48 for x in rnd.integers(0, 2**16, 300)} | {int(x) for x in rnd.integers(0, 2**16, 300)})
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    want = groups({x: x for x in fps}, 3)
    root = {r.node % 2**64: r.root for r in S.components(S.link_forest(df, 3, 40, 4)).collect()}
    assert len({(want[x], root.get(x, x)) for x in fps}) == len(set(want.values())) == len({root.get(x, x) for x in fps})
    assert S.link_forest(df.limit(0), 3, turns=4).count() == 0

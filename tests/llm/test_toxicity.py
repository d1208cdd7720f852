import numpy as np

from sievework.llm import toxicity as T

DOCS = "doc_id long, text string, score string, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rnd = np.random.default_rng(1)
    words = [f"w{a}{b}" for a in "abcdefghijk" for b in "lmnopqrstuvwxyz"]
    docs, toxic = [], {}
    for i in range(n):
        text = list(rnd.choice(words, rnd.integers(5, 80)))
        if i % 8 == 0:
            toxic[i] = 1
            text[rnd.integers(len(text))] = rnd.choice(["nasty", "vilest", "vilely"])
        docs.append((i, " ".join(text).replace("w", rnd.choice(["w", "W"])), "s", 9))
    return docs, toxic


def test_held_out_accuracy(spark):
    docs, toxic = corpus()
    labels = [(i, 1, toxic.get(i, 0)) for i, *_ in docs if i % 3] + [(8, 1, 0), (8, 1, 1), (None, 1, 1), (16, 1, None), (9999, 0, 1)]
    rows = docs + [(1000, None, "s", 9), (1001, "", "s", 9), (1002, "clean " * 50_000, "s", 9), (8, docs[8][1], "s", 9), (None, "nasty", "s", 9)]
    df = spark.createDataFrame(rows, DOCS)
    model = T.learn(df, spark.createDataFrame(labels, LABELS))
    got = T.scored(df, model).collect()
    assert len(got) == len(rows) and T.scored(df, model).columns == ["doc_id", "text", "toxic", "score"]
    told = {r.doc_id: r.score >= 0.5 for r in got}
    assert sum(told[i] for i in toxic) >= 0.9 * len(toxic) and not any(told[i] for i, *_ in docs if i not in toxic)
    assert not told[1000] and not told[1001] and not told[1002]
    read = T.Reader(model.features)
    assert all(abs(r.score - model.score(read(r.text or ""))) < 1e-12 for r in got)


def test_the_risk_is_corrected():
    """Unlabelled rows that are half positive don't pull the positives' feature down."""
    rnd = np.random.default_rng(0)
    positive = [np.array([0, 1 + rnd.integers(5)]) for _ in range(100)]
    unlabelled = [np.array([0, 1 + rnd.integers(5)]) if i % 2 else np.array([1 + rnd.integers(5)]) for i in range(400)]
    w, b = T.fit(positive, unlabelled, 0.5, 6)
    assert w[0] + b + w[1:].max() > 0 > b + w[1:].min()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    assert [r.score for r in T.scored(df, T.learn(df, spark.createDataFrame([], LABELS))).collect()] == [0.0]
    empty = spark.createDataFrame([], DOCS)
    assert T.scored(empty, T.learn(empty, spark.createDataFrame([(1, 1, 1)], LABELS))).collect() == []


def plain_risk(positive, unlabelled, prior, w, b):
    """(the risk that is minimised, whether its negative part is not below 0), by loops."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    z = lambda x: b + sum(w[i] for i in x)
    plus = sum(sigmoid(-z(x)) for x in positive) / len(positive)  # loss of the label 1
    minus_p = sum(sigmoid(z(x)) for x in positive) / len(positive)
    minus_u = sum(sigmoid(z(x)) for x in unlabelled) / len(unlabelled)
    rest = minus_u - prior * minus_p
    return (prior * plus + rest, True) if rest >= 0 else (-rest, False)


def test_first_step_follows_the_plain_risk():
    """Adam's first step is the rate times the gradient's sign; the gradient is that of the risk, by differences."""
    rnd = np.random.default_rng(3)
    positive = [rnd.choice(5, rnd.integers(0, 4), replace=False) for _ in range(20)]
    unlabelled = [rnd.choice(5, rnd.integers(0, 4), replace=False) for _ in range(50)]
    for prior in (0.2, 0.9):
        w, b = T.fit([x.astype(np.int32) for x in positive], [x.astype(np.int32) for x in unlabelled], prior, 5, steps=1, rate=0.1, decay=0.0)
        base = plain_risk(positive, unlabelled, prior, np.zeros(5), -1.0)[0]
        for i in range(5):
            up = np.zeros(5)
            up[i] = 1e-6
            slope = (plain_risk(positive, unlabelled, prior, up, -1.0)[0] - base) / 1e-6
            assert abs(w[i] + 0.1 * slope / (abs(slope) + 1e-8)) < 1e-3
        slope = (plain_risk(positive, unlabelled, prior, np.zeros(5), -1.0 + 1e-6)[0] - base) / 1e-6
        assert abs(b + 1.0 + 0.1 * np.sign(slope)) < 1e-3


def test_long_words_that_begin_alike_differ():
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    assert T.features_of(a)[0] != T.features_of(b)[0] and T.features_of(a)[1:] == T.features_of(b)[1:]

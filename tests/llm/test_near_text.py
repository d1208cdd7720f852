import random

import corpus_pipeline as C
import pytest

from sievework.llm import near_text, simhash
from sievework.llm.simhash import shingle_hashes


def brute(texts):
    sets, root = [frozenset(shingle_hashes(t or "", 5)) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def edited(n=300):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        if texts and i % 3:
            t = rnd.choice(texts).split()
            for _ in range(rnd.randrange(4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
        else:
            t = rnd.choices(words, k=rnd.randrange(3, 200))
        texts.append(" ".join(t))
    boilerplate = "all rights of this text belong to those who wrote it and nobody else may copy it"
    return [f"{t} {boilerplate}" if i % 2 else t for i, t in enumerate(texts)] + ["", None, " "]


@pytest.mark.parametrize("limit", [64, 2])
def test_groups_against_brute_force(spark, limit):
    texts = edited()
    want = brute(texts)
    got = {r.row: r.root for r in near_text.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), bucket_limit=limit, block=16).collect()}
    least = {root: min(i for i in got if got[i] == root) for root in set(got.values())}
    assert len(set(want)) < 250 and [least[got[i]] for i in range(len(texts))] == want


def test_one_edited_word_of_two_hundred_goes(spark):
    rnd = random.Random(4)
    text = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    other = [*text[:90], "edited", *text[91:]]
    docs = spark.createDataFrame([(7, " ".join(other)), (3, " ".join(text)), (9, "another text of its own words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in C.drop_near_copies(spark, docs, "").collect()) == [3, 9]


def test_rows_without_or_with_shared_ids_stay(spark):
    """Rows are told apart by their own numbers, so only copies go."""
    rows = [(None, "alone without an id here now"), (None, "copied text of some six words"), (4, "copied text of some six words"), (5, "one text of five words more"), (5, "other words under the same id"), (6, "one text of five words more"), (5, "one text of five words more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in C.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_fingerprints_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    """Also when they are too many for one node; one order sends each to 42 nodes here, and to more as they grow."""
    sent, real = [], near_text.link_forest

    def counted(distinct, most, **options):
        sent.append((simhash.grouped(distinct.select("fp"), most, 8192, options.get("turns", 1)).count(), distinct.count()))
        return real(distinct, most, **options)

    monkeypatch.setattr(near_text, "link_forest", counted)
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(8))) for i in range(8800)]
    rows += [(8800 + i, rows[i][1]) for i in range(10)]
    got = {r.row: r.root for r in near_text.near_copies(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert all(got[8800 + i] == got[i] for i in range(10)) and len(set(got.values())) == 8800
    assert sent[0][1] > 8192 and sent[0][0] <= 4 * sent[0][1]

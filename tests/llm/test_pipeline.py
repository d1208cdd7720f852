import corpus_pipeline as C
import numpy as np
from test_near_text import brute as near
from test_pii import DOCS as PII_DOCS
from test_pii import brute as spans
from test_pii import documents as identifiers
from test_toxicity import LABELS, corpus

from sievework.llm import toxicity
from sievework.llm.packing import word_tokens


def masked(text):
    out, end = [], 0
    for kind, a, z in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, z)
    return "".join([*out, text[end:]])


def test_against_brute_force(spark, tmp_path):
    docs, toxic = corpus(240)
    texts = [t for _, t, *_ in docs]
    texts += [t + " end" for t in texts[1:40:2]] + texts[3:30:3] + ["mail me at a.b@c.org or +1 (202) 555-0175 now", None, "", "10.0.0.1 and more " * 30]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, toxic.get(i, 0)) for i in range(240) if i % 3], LABELS)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, frame = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = toxicity.learn(frame, labels, folds=0)
    read = toxicity.Reader(model.features)
    clean = {r[0]: r[1] for r in rows if model.score(read(r[1] or "")) < 0.5}
    assert len(rows) - len(clean) > 20
    root = near(list(clean.values()))  # positions, the smallest of each group
    kept = {i: t for n, (i, t) in enumerate(clean.items()) if root[n] == n}
    assert len(kept) < len(clean)
    after = {i: None if t is None else masked(t) for i, t in kept.items()}
    stages = {name: f for name, f in C.STAGES}
    one = stages["toxicity"](spark, frame, sf)
    assert one.columns == frame.columns and sorted(r.doc_id for r in one.collect()) == sorted([*clean, *([5] if 5 in clean else [])])
    two = stages["near_duplicates"](spark, spark.createDataFrame(one.collect(), schema), sf)
    assert two.columns == frame.columns and {r.doc_id: r.text for r in two.collect()} == kept
    three = stages["personal_data"](spark, spark.createDataFrame(two.collect(), schema), sf)
    assert three.columns == frame.columns and {r.doc_id: r.text for r in three.collect()} == after
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in three.collect())

    pieces = C.run(spark, sf).collect()
    ids = {i: [*x.tolist(), 1] for i, x in zip(after, word_tokens(C.public_tokenizers.path("word_bpe_49k.json")).encode_batch([t or "" for t in after.values()]), strict=True)}
    got = {}
    for r in sorted(pieces, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == ids


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_learned_contexts_are_masked(spark):
    rows = identifiers()
    got = {r.doc_id: r.text for r in C.mask_personal_data(spark, spark.createDataFrame(rows, PII_DOCS), "").collect()}
    assert got[120] == "alpha call me: [phone] beta" and got[121] == rows[121][1] and "[phone]" in got[0]


def test_stages_on_defined_cases(spark, tmp_path):
    """An empty table, rows without id, repeated rows, null and very long texts, and columns named as the stages' own."""
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    sf, names = str(tmp_path), "row root digest keys lead toxic_score _toxic _row _pii_row _pii_seen score id".split()
    more = ", ".join(f"{n} string" for n in names)
    long = "word and other words of one long text " * 20_000
    rows = [(None, "one text without any id", "en", "s", 1), (None, None, "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (6, "mail a.b@c.org of one", "en", "s", 5), (7, "word", "en", "s", 4)]
    for data in ([], rows):
        docs = spark.createDataFrame([(*r, *names) for r in data], f"{SCHEMA}, {more}")
        out = docs
        for _, stage in C.STAGES[:-1]:
            out = spark.createDataFrame(stage(spark, out, sf).collect(), docs.schema)
            assert out.columns == docs.columns
        left = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
        want = [(None, "one text without any id", 23), (3, None, None), (5, long, len(long)), (6, "mail [email] of one", 19), (7, "word", 4)]
        assert left == (sorted(want, key=str) if data else [])
        assert all(r[n] == n for r in out.collect() for n in names)
        pieces = C.pack(spark, out, sf).collect()
        assert {r.doc_id for r in pieces} == {i for i, *_ in left}

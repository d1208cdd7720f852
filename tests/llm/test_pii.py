import random
import re

from sievework.llm import pii as P

DOCS = "doc_id long, text string, base string, row int, n string"


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := P.digits_of(m[0])) <= 19 and P.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(P.digits_of(m[0])) <= 15]


def test_base_against_the_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choice("a@@..--%+ 10925()é") for _ in range(rnd.randrange(28)))
        t = "".join(rnd.choice("4 1-0") for _ in range(20)) + t if rnd.random() < 0.3 else t
        assert P.base_spans(t) == brute(t)
    assert P.base_spans("1" * 200_000 + "@" * 50_000 + "1." * 3) == []


def documents(n=60):
    rnd = random.Random(2)
    w = lambda: rnd.choice(["alpha", "beta", "gamma", "delta"])
    out = []
    for i in range(n):
        out.append(f"{w()} {w()} call me: +1 ({200 + i}) 555-{1000 + i} {w()}")
        out.append(f"{w()} {w()} +1 ({300 + i}) 555-{1000 + i} {w()} v{i}.{i} {w()} {i}{i}7{i}88 {w()}")
    out += ["alpha call me: 202-555-0175 beta", "alpha beta call me: v12", "alpha beta 202-555-0188 gamma", None, "", "x" * 3000 + " a@b.c"]
    return [(i, t, "b", 1, "n") for i, t in enumerate(out)]


def test_contexts_find_more(spark):
    rows = documents()
    docs = spark.createDataFrame([*rows, rows[0]], DOCS)
    got = {r.doc_id: r for r in P.found(docs, ["doc_id"]).collect()}
    assert {i: list(r._pii_added) for i, r in got.items() if r._pii_added} == {120: ["phone:15:27"]}
    assert {i: r._pii_base for i, r in got.items()} == {i: ",".join(f"{k}:{a}:{z}" for k, a, z in brute(t or "")) for i, t, *_ in rows}
    text = {r.doc_id: r.text for r in P.redacted(docs).collect()}
    assert text[120] == "alpha call me: [phone] beta" and text[121] == "alpha beta call me: v12" and text[125].endswith(" [email]") and text[123] is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.found(empty, ["doc_id"]).collect() == [] and P.redacted(empty).collect() == []


def test_contexts_with_many_unseen(spark):
    """40 % of the numbers in a context miss the base and are found; a context of mostly other numbers stays."""
    texts = [f"alpha call me: +1 ({200 + i}) 555-{1000 + i} beta" for i in range(60)] + [f"alpha call me: {200 + i}-555-{2000 + i} beta" for i in range(40)]
    texts += [f"order number: +1 ({300 + i}) 555-{1000 + i} gamma" for i in range(10)] + [f"order number: {5000000 + 37 * i} gamma" for i in range(200)]
    docs = spark.createDataFrame([(i, t, "b", 1, "n") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id for r in P.found(docs, ["doc_id"]).collect() if r._pii_added}
    assert got == set(range(60, 100))

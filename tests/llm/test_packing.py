import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sievework.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string, ids int"


OWN = Tokenizer.from_file(PATH)


def own_ids(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizers():
    rnd = random.Random(4)
    chars = [" ", " ", "\n", "a", "B", "é", "é", "́", "Σ", "'s", "1", "²", "\t", "\x1c", " ", "!", "<|endoftext|>", "日", "\x00", "İ"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(40))) for _ in range(6000)] + ["don't", "l'été", "ÀÉß×÷ª", "a'sb", "" , "x" * 30_000]
    assert [x.tolist() for x in P.WordTokens(PATH).encode_batch(texts)] == [own_ids(t)[:-1] for t in texts]


def test_ids_of_capitals():
    rnd = random.Random(6)
    chars = [" ", " ", "\n", "a", "B", "É", "é", "E\u0301", "Σ", "ΑΣ", "'S", "'s", "'LL", "1", "K", "\u212a", "!", ",", "...", "|", "日", "İ", "Ǆ"]
    texts = pa.array([None, *("".join(rnd.choice(chars) for _ in range(rnd.randrange(40))) for _ in range(4000))])
    for begin, size in ((0, 4001), (1, 7), (900, 2500), (4000, 1)):  # Arrow gives parts of arrays
        part = texts.slice(begin, size).fill_null("")
        assert [x.tolist() for x in P.WordTokens(PATH).encode_batch(part)] == [own_ids(t)[:-1] for t in part.to_pylist()]
    for more in (["<|ENDOFTEXT|> A"], ["A <|endoftext|>B", "<|startOfText|>"]):
        assert [x.tolist() for x in P.WordTokens(PATH).encode_batch(["The END", *more])] == [own_ids(t)[:-1] for t in ["The END", *more]]


def test_pieces(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "the", "Beta", "gamma!", "éa"]) for _ in range(rnd.randrange(400))) for _ in range(150)] + [None, "", "word " * 9000] + ["same copy of a text"] * 200
    rows = [(i, t, "no", 1) for i, t in enumerate(texts)] + [(3, texts[3], "no", 1)]
    got = [r.asDict() for r in P.packed(spark.createDataFrame(rows, DOCS), PATH).collect()]
    ids = {i: own_ids(t) for i, t, *_ in rows}
    pieces, sequences = {}, {}
    for r in got:
        x = np.frombuffer(r["ids"], "<u4").tolist()
        assert x == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(x, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, spans in pieces.items():
        covered = sorted(x for s, n in spans for x in range(s, s + n))
        assert covered == sorted(list(range(len(ids[i]))) * (2 if i == 3 else 1))
    total = sum(map(len, ids.values())) + len(ids[3])
    sizes = []
    for k in sorted(sequences):
        at = 0
        for offset, n in sorted(sequences[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sum(sizes) == total and all(n <= 2048 and n & (n - 1) == 0 for n in sizes) and sizes[: total // 2048] == [2048] * (total // 2048)
    assert sorted(sequences) == list(range(len(sizes)))


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_hilbert_keys_visit_neighbours():
    g = np.array(np.meshgrid(*[np.arange(4)] * 3, indexing="ij")).reshape(3, -1).T
    keys = P.hilbert_keys((g + 0.5) / 4, 2)
    assert sorted(keys) == list(range(64)) and np.abs(np.diff(g[np.argsort(keys)], axis=0)).sum(1).max() == 1

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from sievework.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, n_tokens string, ids_sha256 int"
RANKS = B.read_ranks(PATH)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def plain(text):
    """The rank merge by definition: of all neighbours the pair of the smallest rank, the leftmost first, until none has a rank."""
    out = []
    for token in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in token.encode("utf-8", "replace")]
        while len(parts) > 1:
            rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


CHARS = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "a", "the", "thonnd", "É", "é", "e\u0301", "ß", "日本", "🙂", "👩‍👩‍👧", "1", "1234", "'s", "'LL", "don't", "<|endoftext|>", "<|", "!", "...", "\x00", "_", "İ", "\ufeff", "▁"]


def texts(n=4000):
    rnd = random.Random(6)
    out = ["".join(rnd.choice(CHARS) for _ in range(rnd.randrange(30))) for _ in range(n)]
    return [*out, "", " ", "a" * 3000, "ab" * 2000, " " * 500 + "x", "x" + " " * 500, "<|endoftext|><|startoftext|>", "".join(map(chr, range(1, 1500)))]


def test_ids_equal_a_plain_merge_and_the_library():
    own, all_texts = B.Codec(PATH), texts()
    got = [list(x) for i in range(0, len(all_texts), 300) for x in own.encode_batch(all_texts[i : i + 300])]
    for t, ids in zip(all_texts, got, strict=True):
        assert ids == OWN.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()
    for t, ids in zip(all_texts[:800], got, strict=False):
        assert ids == plain(t), repr(t)


def test_digests_of_documents(spark):
    all_texts = texts(300)
    rows = [(i, t, "x", 1) for i, t in enumerate(all_texts)] + [(None, "no id here", "x", 1), (900, None, "x", 1), (3, all_texts[3], "x", 1), (901, "word and more " * 30_000, "x", 1)]
    got = sorted((tuple(r) for r in B.digests(spark.createDataFrame(rows, DOCS).repartition(3), PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids := OWN.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert B.digests(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_encoded_rows_decode_again(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(50))]
    back = B.decode_ids(B.encode_documents(spark.createDataFrame(rows, DOCS), PATH), PATH).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: t.encode() for i, t, *_ in rows}


@pytest.mark.parametrize("t", ["thonnd erea ouen", "Éé ß ▁x"])
def test_the_model_is_a_serialised_one(t):
    """The pieces are scored by negative rank, so sentencepiece merges as the ranks say."""
    own = B.Codec(PATH)
    assert own.model.get_piece_size() == len(RANKS) + 1 and own.model.get_score(5) == -5.0
    assert own.encode(t) == plain(t)

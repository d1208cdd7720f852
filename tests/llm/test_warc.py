import gzip
import hashlib
import io
import random

import pytest

from sievework.llm import warc as W

PAGES = "page_id long, url string, html string, record_type string, digest int"


def test_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    html = ["é" * 70_001, "<p>" + "x" * 200, None, "", "short", "short", "y" * 99, "y" * 99, "z" * 100, "z" * 100, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9] + ["<p>" + "x" * 200] * 5
    html += ["".join(rnd.choice("aé日\r\n\0") for _ in range(rnd.randrange(9000))) for _ in range(20)]
    rows = [(i, "http://a/ \r\nX: 1" if i % 3 else None, h, "no", 1) for i, h in enumerate(html)]
    rows += [rows[0], rows[0], (None, "u", "z" * 100, "", 0), (None, "u", "n" * 500, "", 0), (None, "u", "n" * 500, "", 0)]
    W.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / "w"), segment_bytes=1000)
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_archives(spark, str(tmp_path / "w")).collect()), key=str)
    seen, want = {}, []
    for i, _, h, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        p = (h or "").encode()
        old = len(p) >= 100 and seen.get(p, i) != i
        want.append((i if i is not None else -1, len(p), hashlib.sha256(p).hexdigest(), "revisit" if old else "response", seen[p] if old else None))
        seen.setdefault(p, i)
    assert got == sorted(want, key=str)
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("part-*.gz"))
    assert {f["warc-type"] for f, _ in W.parse(io.BytesIO(raw))} == {"response", "revisit", "continuation"}


def test_missing_segments_are_told(spark, tmp_path):
    spark.createDataFrame([(b"\r\n\r\n".join(r for k, r in enumerate(W.records(1, "u", b"x" * 5000, hashlib.sha256(b"x" * 5000).hexdigest(), None, 1000)) if k != 2),)], "v binary").selectExpr("cast(v as string) v").write.option("lineSep", "\r\n\r\n").text(str(tmp_path / "w"))
    with pytest.raises(Exception, match="are missing"):
        W.read_archives(spark, str(tmp_path / "w")).collect()


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).collect() == []


def test_chunks():
    for n in (0, 1, 8192, 20000):
        assert W.unchunked(W.chunked(b"q" * n)) == b"q" * n
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        W.unchunked(b"5\r\nabc")

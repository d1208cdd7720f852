import io

import numpy as np
import pytest

from sievework.functions import images as I
from sievework.plans import bridge, curation


def test_staged_run(spark, tmp_path):
    items = bridge.photos(spark, "/root/testdata/sf0.001")
    out = curation.run(spark, items, str(tmp_path))
    assert {"filename", "pick", "score", "cluster_id"} <= set(out.columns) and out.count() > 0
    again = curation.run(spark, items, str(tmp_path), from_stage="select", dry_run=True)
    assert sorted(r.path for r in again.collect()) == sorted(r.path for r in out.collect())


def test_image_metrics():
    flat = bytes([100, 150, 200] * 64)
    blur, exposure, detail, flesh, mundane = I.measure(8, 8, flat)
    assert blur == 0 and detail == 0 and abs(exposure - 141 / 255) < 0.01 and flesh == 0 and mundane > 0.7
    skin = bytes([220, 170, 140] * 64)
    assert I.measure(8, 8, skin)[3] == 1 and I.measure(8, 8, skin)[4] == 0
    board = np.indices((8, 8)).sum(0) % 2 * 255
    assert I.measure(8, 8, board.astype(np.uint8).tobytes())[0] > 1e5
    assert I.decode(b"no image") is None


def test_decoding_needs_pillow():
    image = pytest.importorskip("PIL.Image")
    image.new("RGB", (3, 2), (1, 2, 3)).save(f := io.BytesIO(), "PNG")
    assert I.decode(f.getvalue()) == (2, 3, bytes([1, 2, 3] * 6))


def test_sketches_are_stable():
    x = np.add.outer(np.arange(64) * 2.0, np.arange(64))
    for kind in ("ahash", "dhash", "phash"):
        noise = np.random.default_rng(1).random((64, 64)) * 200
        a, b = I.sketch(noise, kind), I.sketch(noise + 3, kind)
        assert len(a) == 16 and (int(a, 16) ^ int(b, 16)).bit_count() <= 2
    assert I.sketch(x, "dhash") == "f" * 16


def test_reduced_vectors(spark):
    from sievework.operators.features import reduced

    rnd = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rnd.standard_normal(6).tolist() if i else None) for i in range(20)], "id long, v array<double>")
    got = [r.f for r in reduced(df, "v", 3, 1.5, "f").collect()]
    assert all(abs(np.linalg.norm(f) - 1.5) < 1e-6 for f in got)
    assert all(r.f == [0.0] * 32 for r in reduced(df, "v", 32, out="f").collect())

import hashlib
import io
import zlib

import numpy as np
import pytest

from millrace.llm import media
from millrace.llm.media import area_resize, decode, difference_hash, encode_bmp, encode_pgm, media_tiles, npy_tile, stored_texts


def slow_resize(x, height, width):
    h, w, d = x.shape
    fine = np.repeat(np.repeat(x.astype(float), height, 0), width, 1)
    return fine.reshape(height, h, width, w, d).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 9), (17, 64), (40, 2)])
def test_area_resize(shape, monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, (*shape, 3), dtype=np.uint8)
    for size in ((8, 9), (2, 2), (32, 32), (1, 1)):
        assert np.allclose(area_resize(x, *size), slow_resize(x, *size))
    monkeypatch.setattr(media, "_BAND", 3)
    assert np.allclose(area_resize(x, 8, 9), slow_resize(x, 8, 9))


def test_formats():
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3) * 9
    grey = x[:, :, :1]
    assert (decode(b"P6 # note\n4 2\n#x\n255\n" + x.tobytes()) == x).all()
    assert (decode(b"P3\n4 2 255\n" + b" ".join(b"%d" % v for v in x.ravel()) + b"\n# end") == x).all()
    assert (decode(b"P5 4 2 255 " + grey.tobytes()) == grey).all()
    assert (decode(b"P2 4 2 255 " + b"\n".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (decode(b"P5 4 2 999 " + (grey.astype(int) + 300).astype(">u2").tobytes()) == grey.astype(int) + 300).all()
    assert decode(b"P1 3 2 101\n010").ravel().tolist() == decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).ravel().tolist() == [0, 1, 0, 1, 0, 1]
    assert (decode(encode_bmp(x)) == x).all() and (decode(encode_bmp(grey)) == grey).all()
    flipped = bytearray(encode_bmp(x[::-1]))
    flipped[22:26] = (-2).to_bytes(4, "little", signed=True)
    assert (decode(bytes(flipped)) == x).all()
    for bad in (b"", b"P5 4", b"P5 4 2 255 abc", b"P9 1 1 1 a", b"BM123", b"P5 0 2 255 ", b"P2 1 1 9 77", encode_bmp(x)[:40]):
        with pytest.raises((ValueError, media.struct.error)):
            decode(bad)


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))[:, :, None]
    assert difference_hash(ramp) == "ff" * 8 and difference_hash(ramp[:, ::-1]) == "00" * 8
    tile = np.load(io.BytesIO(npy_tile(ramp, 32)))
    assert tile.shape == (32, 32, 1) and tile.dtype == np.uint8


def test_tiles(spark):
    x = np.random.default_rng(1).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    rows = [("a", b"P6 30 20 255 " + x.tobytes()), ("b", encode_bmp(x)), (None, None), ("bad", b"P6 30 20 255 x"), ("b", encode_bmp(x))]
    got = media_tiles(spark.createDataFrame([(*r, 1) for r in rows], "media_id string, media binary, width int")).collect()
    good = [r for r in got if r.error is None]
    assert len(got) == 5 and len(good) == 3 and len({(r.tile, r.dhash, r.width, r.height, r.bits) for r in good}) == 1
    assert np.array_equal(np.load(io.BytesIO(good[0].tile)), np.rint(slow_resize(x, 32, 32)).astype(np.uint8))


def test_texts_come_back(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, "long " * 100_000, "\0" * 70, "a"]
    df = spark.createDataFrame([(i if i else None, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got, kinds = {r.doc_id: r for r in stored_texts(df).collect()}, set()
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i if i else None]
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        image = np.frombuffer(pay, np.uint8).reshape(-1, 64)
        stored = encode_bmp(image) if zlib.crc32(pay) % 2 else encode_pgm(pay)
        kinds.add(stored[:2])
        assert tuple(r)[1:7] == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        if len(pay) < 3000:
            tile = np.rint(slow_resize(image[:, :, None], 32, 32)).astype(np.uint8)
            assert r.feature == difference_hash(image[:, :, None]) + "-" + hashlib.sha256(tile.tobytes()).hexdigest()[:16]
    assert kinds == {b"BM", b"P5"}
    assert got[2].feature == got[7].feature
    assert stored_texts(df.limit(0)).collect() == []

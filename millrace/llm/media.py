"""Media columns: Netpbm and BMP images decoded to numpy, area-resized, kept as NPY tiles.

Resizing takes exact area means, fractions of pixels included, from an integral image of which only the
rows at the boundaries are kept: a very tall image is summed in bands. The difference hash compares
neighbouring cells of a 9 x 8 grid.

Cases with a defined result: null or malformed media give null columns and an ``error``; a null text is
stored as an empty payload, which is padded to 64 bytes; repeated rows give equal values; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WIDTH, TILE = 64, 32
_BAND = 1 << 14
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as a binary grey map of the given width; its length must be a multiple of that."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is no positive multiple of the width")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey (8-bit, palette) or colour (24-bit) image as an uncompressed, bottom-up BMP."""
    h, w = image.shape[:2]
    grey = image.ndim == 2 or image.shape[2] == 1
    rows = image.reshape(h, w) if grey else image[:, :, ::-1].reshape(h, w * 3)
    pad = -rows.shape[1] % 4
    body = np.pad(rows[::-1], ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    at = 54 + palette.size
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette.tobytes() + body


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1:2], 2, []
    while len(head) < (2 if kind in b"14" else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header is cut")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if w < 1 or h < 1 or not 1 <= top <= 65535:
        raise ValueError("bad dimensions")
    deep = 3 if kind in b"36" else 1
    n = w * h * deep
    if kind in b"123":
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        x = np.array([c - 48 for c in body if c in b"01"], np.int64) if kind == b"1" else np.array(body.split(), np.int64)
        if len(x) < n:
            raise ValueError("samples are missing")
        x = x[:n]
    elif kind == b"4":
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row)
        x = np.unpackbits(raw, axis=1)[:, :w].reshape(-1)
    else:
        x = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if kind in b"14":
        x = 1 - x.astype(np.uint8)  # a set bit is black
    if x.max(initial=0) > top:
        raise ValueError("a sample is above its maximum")
    return x.astype(np.uint16 if top > 255 else np.uint8, copy=False).reshape(h, w, deep)


def _bmp(data: bytes) -> np.ndarray:
    at, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40 or w < 1 or h == 0 or packed not in (0,) or bits not in (8, 24, 32):
        raise ValueError("this BMP kind isn't read")
    row = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
    raw = raw[::-1] if h > 0 else raw
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        if raw.max(initial=0) >= colours:
            raise ValueError("a sample is outside the palette")
        grey = (palette == palette[:, :1]).all()
        return palette[raw][:, :, :1] if grey else palette[raw]
    return raw.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, 8 or 16 bits a sample."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means as float64, height x width x channels."""
    h, w, deep = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    need = np.unique(np.concatenate([np.floor(ys), np.minimum(np.floor(ys) + 1, h)]).astype(np.int64))
    kept = np.zeros((len(need), w + 1, deep))
    total = np.zeros((w, deep))
    for top in range(0, h, _BAND):
        sums = np.cumsum(image[top : top + _BAND], axis=0, dtype=np.float64) + total
        mine = np.flatnonzero((need > top) & (need <= top + len(sums)))
        kept[mine, 1:] = np.cumsum(sums[need[mine] - top - 1], axis=1)
        total = sums[-1]
    y0, x0 = np.minimum(np.floor(ys), h).astype(np.int64), np.minimum(np.floor(xs), w).astype(np.int64)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    lower, upper = kept[np.searchsorted(need, y0)], kept[np.searchsorted(need, np.minimum(y0 + 1, h))]
    rows = lower + (upper - lower) * fy
    at = rows[:, x0] + (rows[:, np.minimum(x0 + 1, w)] - rows[:, x0]) * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is brighter than its left neighbour (means rounded to 1e-6)."""
    grid = np.rint(area_resize(image, 8, 9).mean(axis=2) * 1e6)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image at size x size as the bytes of an NPY file of its own sample type."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, size, size)).astype(image.dtype))
    return out.getvalue()


def media_tiles(media: DataFrame, id_col: str = "media_id", media_col: str = "media", size: int = TILE) -> DataFrame:
    """``id, media`` (binary) → ``id, width, height, channels, bits, tile`` (NPY bytes)``, dhash, error``."""
    bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1):
                try:
                    if not data.is_valid:
                        raise ValueError("null")
                    x = decode(data.as_py())
                    out.append((x.shape[1], x.shape[0], x.shape[2], 8 * x.dtype.itemsize, npy_tile(x, size), difference_hash(x), None))
                except (ValueError, struct.error, IndexError, OverflowError) as e:
                    out.append((None,) * 6 + (str(e)[:200] or "malformed",))
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
            names = ["width", "height", "channels", "bits", "tile", "dhash", "error"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))] if out else [b.column(0), *(pa.array([], k) for k in kinds)], ["id", *names])

    kind = media.select(F.col(id_col)).dtypes[0][1]
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, width int, height int, channels int, bits int, tile binary, dhash string, error string")


def store(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as a grey image: one of odd CRC-32 as BMP, the others as binary grey map."""
    if zlib.crc32(payload) % 2:
        return encode_bmp(np.frombuffer(payload, np.uint8).reshape(-1, width))
    return encode_pgm(payload, width)


def feature(image: np.ndarray, size: int = TILE) -> str:
    """The difference hash, and 64 bits of the SHA-256 of what is read back from the NPY tile."""
    tile = np.load(io.BytesIO(npy_tile(image, size)))
    return f"{difference_hash(image)}-{hashlib.sha256(tile.tobytes()).hexdigest()[:16]}"


def stored_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every text stored as a Netpbm or BMP image and read back, its tile written as NPY and read back too: ``doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature``."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (text.as_py() or "").encode()
                media = store(raw + bytes(-len(raw) % width if raw else width), width)
                image = decode(media)
                back = image.tobytes()
                out.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

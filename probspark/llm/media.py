"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized tiles as NPY bytes, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Staged, cut

_HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAX = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def decode(media: bytes) -> np.ndarray:
    """(height, width, channels) uint8 array of a Netpbm P1-P6 image of 8 bits a sample or less, or of an uncompressed 24-bit BMP.

    Bitmaps become 0 and 255; other samples are returned as stored.  Bad or cut images raise ValueError.
    """
    if media[:2] == b"BM":
        off = int.from_bytes(media[10:14], "little")
        w, h = int.from_bytes(media[18:22], "little"), int.from_bytes(media[22:26], "little", signed=True)
        if int.from_bytes(media[28:30], "little") != 24 or int.from_bytes(media[30:34], "little"):
            raise ValueError("only uncompressed 24-bit BMP")
        row = (3 * w + 3) // 4 * 4
        if len(media) < 54 or len(media) < off + row * abs(h):
            raise ValueError("BMP is cut")
        a = np.frombuffer(media, np.uint8, row * abs(h), off).reshape(abs(h), row)[:, : 3 * w].reshape(abs(h), w, 3)
        return (a[::-1] if h > 0 else a)[:, :, ::-1]
    m = _HEAD.match(media)
    if not m:
        raise ValueError("neither Netpbm nor BMP")
    kind, w, h = (int(x) for x in m.groups())
    at, top, c = m.end(), 1, 3 if kind in (3, 6) else 1
    if kind not in (1, 4):
        mm = _MAX.match(media, at)
        if not mm or not 0 < (top := int(mm[1])) < 256:
            raise ValueError("only samples of 8 bits")
        at = mm.end()
    if kind == 4:
        row = (w + 7) // 8
        if len(media) < at + 1 + row * h:
            raise ValueError("Netpbm is cut")
        a = np.frombuffer(media, np.uint8, row * h, at + 1).reshape(h, row)
        return ((1 - np.unpackbits(a, axis=1)[:, :w]) * 255).astype(np.uint8).reshape(h, w, 1)
    if kind in (5, 6):
        if len(media) < at + 1 + w * h * c:
            raise ValueError("Netpbm is cut")
        return np.frombuffer(media, np.uint8, w * h * c, at + 1).reshape(h, w, c)
    body = re.sub(rb"#[^\n]*", b"", media[at:])
    a = np.array(re.findall(rb"[01]", body) if kind == 1 else body.split() or [], dtype=np.int64)[: w * h * c]
    if a.size < w * h * c:
        raise ValueError("Netpbm is cut")
    return ((1 - a) * 255 if kind == 1 else a).astype(np.uint8).reshape(h, w, c)


def encode_ppm(a: np.ndarray) -> bytes:
    """Binary Netpbm of an (h, w, 1 or 3) uint8 array."""
    return b"P%d\n%d %d\n255\n" % (6 if a.shape[2] == 3 else 5, a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of an (h, w, 3) uint8 array."""
    h, w, _ = a.shape
    row = (3 * w + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = a[::-1, :, ::-1].reshape(h, 3 * w)
    n = row * h
    return b"BM" + (54 + n).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\x01\0\x18\0" + bytes(4) + n.to_bytes(4, "little") + bytes(16) + body.tobytes()


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of each of h x w equal areas, fractions of pixels included, from one integral image."""
    H, W, c = a.shape
    s = np.zeros((H + 1, W + 1, c))
    np.cumsum(np.cumsum(a, 0, dtype=np.int64), 1, out=s[1:, 1:])

    def cut(s, n, k):
        at = np.arange(k + 1) * n / k
        lo = np.minimum(at.astype(np.int64), n - 1)
        f = (at - lo).reshape(-1, *[1] * (s.ndim - 1))
        return s[lo] * (1 - f) + s[lo + 1] * f

    s = cut(s, H, h)
    s = cut(s.transpose(1, 0, 2), W, w).transpose(1, 0, 2)
    return np.diff(np.diff(s, axis=0), axis=1) * (h * w / (H * W))


def dhash(a: np.ndarray) -> str:
    """64 bits as hex: each of 8 x 8 grey cells against its right neighbour, after an area resize to 9 x 8."""
    g = np.round(area_resize(a, 8, 9).mean(2), 6)
    return np.packbits(g[:, 1:] > g[:, :-1]).tobytes().hex()


def npy_tile(a: np.ndarray, side: int) -> bytes:
    """The image as a side x side tile in NPY bytes (uint8, rounded half up)."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(a, side, side) + 0.5).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def _store(width: int):
    def run(batches):
        for b in cut(batches):
            sizes, media = [], []
            for t in b.column("text").to_pylist():
                p = (t or "").encode()
                sizes.append(len(p))
                unit = 3 * width
                p += b" " * (unit - len(p) if not p else -len(p) % unit)
                media.append(b"P6\n%d %d\n255\n" % (width, len(p) // unit) + p)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def _media_rows(side: int):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for b in cut(batches, "media"):
            out = []
            for doc, n, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                try:
                    a = decode(media or b"")
                    if not a.size:
                        raise ValueError("an image without samples")
                except ValueError:  # null, cut or unknown: a row without features
                    out.append((doc, n, *[None] * (len(names) - 2)))
                    continue
                p = a.tobytes()
                out.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), dhash(a), npy_tile(a, side)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    return run


def text_media(documents: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, filled with spaces to whole rows, as an RGB Netpbm image ``width`` wide.

    Null and empty texts are one row of spaces.  Repeated rows stay rows of their own.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store(width), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, side: int = 16) -> DataFrame:
    """Features of a stored media column (doc_id, n_bytes, media): digests of what is read back, difference hash, NPY tile.

    A null, broken or empty image gives nulls in all of them.  Repeated rows stay rows of their own; an empty table gives no rows.
    """
    return media.mapInArrow(_media_rows(side), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Digests and features of all documents' texts as stored images; nulls, empties and repeated rows as in text_media()."""
    stored = Staged(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    f = media_features(stored.df)
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"))

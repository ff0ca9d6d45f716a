"""Lossless images in binary columns: a PNG writer and reader in numpy and zlib, and a cosine-transform hash."""

import hashlib
import struct as st
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from meterline.llm.common import documents, map_columns

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return st.pack(">I", len(body)) + kind + body + st.pack(">I", zlib.crc32(kind + body))


def _filters(rows: np.ndarray) -> np.ndarray:
    """Each row by the filter (none, sub, up) with the least sum of absolute signed residuals; ties: the first."""
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    return np.concatenate([kind[:, None].astype(np.uint8), tried[kind, np.arange(len(rows))]], axis=1)


def png_encode(pixels: np.ndarray, level: int = 3) -> bytes:
    """8-bit grey PNG of a (height, width) array of bytes."""
    h, w = pixels.shape
    head = st.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(_filters(pixels).tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kind: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Rows back from filters 0 to 4. Runs of rows with filters none, sub and up are undone together."""
    h, w = raw.shape
    out = raw.copy()
    sub = kind == 1
    out[sub] = np.cumsum(raw[sub], axis=1, dtype=np.uint8)
    k = 0
    while k < h:
        f = kind[k]
        if f == 2:
            end = k + 1
            while end < h and kind[end] == 2:
                end += 1
            first = out[k - 1 : k] if k else np.zeros((1, w), np.uint8)
            out[k:end] = np.cumsum(np.concatenate([first, raw[k:end]]), axis=0, dtype=np.uint8)[1:]
            k = end
            continue
        if f in (3, 4):
            above = out[k - 1].astype(int) if k else np.zeros(w, int)
            a = c = 0
            for x in range(w):
                b = int(above[x])
                if f == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                a, c = (int(raw[k, x]) + guess) & 255, b
                out[k, x] = a
        elif f > 4:
            raise ValueError(f"filter {f}")
        k += 1
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The (height, width) bytes of an 8-bit grey PNG that isn't interlaced; each chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, idat, shape = 8, [], None
    while at < len(data):
        n, kind = st.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or st.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r}: wrong checksum")
        if kind == b"IHDR":
            w, h, *rest = st.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey without interlacing is read")
            shape = h, w
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    h, w = shape
    rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, w + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(low)[:, None] / (2 * n))


COSINES = _cosines(32, 8)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the image, brought to 32 x 32 by means over
    equal bands, lie above their median (the constant one left out of it)."""
    h, w = pixels.shape
    cum = np.zeros((h + 1, w + 1))
    cum[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    ys, xs = np.linspace(0, h, 33), np.linspace(0, w, 33)

    def between(c: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo = np.minimum(at.astype(int), len(c) - 2)
        f = (at - lo)[:, None]
        return c[lo] * (1 - f) + c[lo + 1] * f

    grid = np.diff(np.diff(between(between(cum, ys).T, xs).T, axis=0), axis=1) / ((h / 32) * (w / 32))
    low = (COSINES @ grid @ COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_payload(text: str | None) -> tuple[int, np.ndarray]:
    raw = (text or "").encode()
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return len(raw), np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)


def png_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, image): each whole text as UTF-8, padded with bytes 0 to a positive multiple of 64, as the
    samples of a grey PNG 64 wide. A null text is the empty one. Equal texts give equal images."""

    def make():
        def fn(doc_id, text):
            made = [text_payload(t) for t in text]
            return [doc_id, [n for n, _ in made], [png_encode(p) for _, p in made]]

        return fn

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, image binary")


def png_features(images: DataFrame) -> DataFrame:
    """Reads each image back and returns digests of payload and image, and the cosine hash."""

    def one(n, image):
        pixels = png_decode(image)
        raw = pixels.tobytes()
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(pixels))

    def make():
        def fn(doc_id, n_bytes, image):
            return [doc_id, n_bytes, *map(list, zip(*map(one, n_bytes, image), strict=True))]

        return fn

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_columns(images.select("doc_id", "n_bytes", "image"), make, ddl)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as PNG and read back. Null and empty texts are 64 bytes 0; equal texts give equal values, so
    repeated rows do; an empty table gives no rows; other columns are left out."""
    return png_features(png_column(documents(spark, sf_dir)))

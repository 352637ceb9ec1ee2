"""Media columns: Netpbm and BMP images in binary columns, resized by area, tiled and fingerprinted.

Images are decoded to numpy arrays (height x width x channels, 8 bits). A
resize to h x w averages the exact source area below each target pixel with an
integral image. A tile is the resized image in NPY form, and its feature the
difference hash of a 9 x 8 grey area-resize: 64 bits, each telling whether a
pixel is brighter than its right neighbour.

Any bytes can be stored as an image without loss: ``bytes_to_image`` pads them
with zeros to a positive multiple of 64 and lays them out in rows of 64 grey
samples, as a binary PGM or an 8-bit BMP.

Defined cases: a null text is an empty one, stored as one row of zeros; a null
or damaged image has null results (``decode`` raises for a single one); equal
bytes give equal rows; an empty table gives an empty result; an existing column
of the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow_columns

ROW = 64
TILE = (32, 32)


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image.reshape(h, w), np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Grey images with a 256-entry palette, colour ones with 24 bits a pixel; rows bottom up, padded to four bytes."""
    h, w, c = image.shape
    rows = image[::-1, :, ::-1] if c == 3 else image[::-1]
    body = np.zeros((h, -(-w * c // 4) * 4), np.uint8)
    body[:, : w * c] = rows.reshape(h, w * c)
    palette = b"" if c == 3 else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, w, h, 1, 8 * c, 0, body.size, 2835, 2835, 256 if palette else 0, 0)
    return head + palette + body.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The first numbers of a Netpbm header, and where the raster begins."""
    found: list[int] = []
    at = 2
    while len(found) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                while at < len(data) and data[at] not in (10, 13):
                    at += 1
            else:
                at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("Netpbm header is damaged")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with up to 8 bits a sample; other maxima are scaled to 255."""
    kind = data[1] - 48
    colour, bitmap = kind in (3, 6), kind in (1, 4)
    numbers, at = _header(data, 2 if bitmap else 3)
    w, h = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not 0 < top < 256 or w < 1 or h < 1:
        raise ValueError("Netpbm header is not supported")
    channels = 3 if colour else 1
    if kind == 4:
        stride = -(-w // 8)
        raw = np.frombuffer(data, np.uint8, h * stride, at).reshape(h, stride)
        samples = np.unpackbits(raw, axis=1)[:, :w]
    elif kind in (5, 6):
        samples = np.frombuffer(data, np.uint8, h * w * channels, at)
    elif kind == 1:
        samples = np.array([c - 48 for c in data[at - 1 :] if c in (48, 49)][: h * w], np.uint8)
    else:
        samples = np.array(data[at - 1 :].split()[: h * w * channels], np.uint8)
    image = samples.reshape(h, w, channels)
    if not bitmap and image.max() > top:
        raise ValueError("Netpbm sample is over the maximum")
    if bitmap:
        return (1 - image) * np.uint8(255)
    return image if top == 255 else (image.astype(np.uint16) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit images, bottom up or top down."""
    start, _, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("BMP form is not supported")
    depth = bits // 8
    stride = -(-w * depth // 4) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * depth].reshape(abs(h), w, depth)
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return rows[:, :, 2::-1]
    size = struct.unpack_from("<I", data, 14)[0]
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    image = palette[rows[:, :, 0]]
    return image[:, :, :1] if (palette == palette[:, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels; every kind of damage is a ValueError."""
    try:
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return decode_netpbm(data)
    except (OverflowError, IndexError, TypeError, struct.error) as broken:
        raise ValueError("image is damaged") from broken
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the exact source area of each target pixel, as float64."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, image.shape[2]))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(axis_sums: np.ndarray, n: int, size: int) -> np.ndarray:
        edges = np.linspace(0, size, n + 1)
        low = np.minimum(edges.astype(int), size - 1)
        part = (edges - low).reshape(-1, *[1] * (axis_sums.ndim - 1))
        return axis_sums[low] * (1 - part) + axis_sums[low + 1] * part

    sums = at(total, height, h)
    sums = at(sums.swapaxes(0, 1), width, w).swapaxes(0, 1)
    cells = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return cells * (height * width / (h * w))


def npy_tile(image: np.ndarray, height: int = TILE[0], width: int = TILE[1]) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    grey = area_resize(image, 8, 9).mean(axis=2)
    # Rounded, so that equal areas stay equal whatever the order of the sums.
    bits = np.round(grey[:, :-1], 6) > np.round(grey[:, 1:], 6)
    return np.packbits(bits).tobytes().hex()


def bytes_to_image(payload: bytes, form: str = "pgm") -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1)
    return encode_bmp(image) if form == "bmp" else encode_pgm(image)


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


STORED_FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
]
FEATURE_FIELDS = [
    T.StructField("height", T.LongType()),
    T.StructField("width", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("tile", T.BinaryType()),
]
DIGEST_FIELDS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
]


def store_texts(df: DataFrame, text: str = "text", form: str = "pgm") -> DataFrame:
    """``df`` with every whole text stored as an image in ``media``, and its size in bytes."""

    def make(batch: pa.RecordBatch) -> list:
        raws = batch.column(text).cast(pa.large_binary()).to_pylist()
        return [[len(r or b"") for r in raws], [bytes_to_image(padded(r or b""), form) for r in raws]]

    return with_arrow_columns(df, text, STORED_FIELDS, make)


def _decoded(data: bytes | None) -> np.ndarray | None:
    try:
        return None if data is None else decode(data)
    except ValueError:
        return None


def _features(image: np.ndarray | None) -> tuple:
    if image is None:
        return (None,) * 4
    return image.shape[0], image.shape[1], difference_hash(image), npy_tile(image)


def _digest(data: bytes | None, image: np.ndarray | None) -> tuple:
    """Of a damaged image only the stored form is told."""
    payload = None if image is None else image.tobytes()
    read = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]))
    return (*read, *((None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())))


def _columns(rows: list[tuple], fields: list[T.StructField]) -> list:
    return [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * len(fields)


def image_features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with size, difference hash and NPY tile of each image."""
    return with_arrow_columns(df, media, FEATURE_FIELDS, lambda batch: _columns([_features(_decoded(x)) for x in batch.column(media).to_pylist()], FEATURE_FIELDS))


def media_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with digests of the samples read back from each image and of its stored form."""
    return with_arrow_columns(df, media, DIGEST_FIELDS, lambda batch: _columns([_digest(x, _decoded(x)) for x in batch.column(media).to_pylist()], DIGEST_FIELDS))


SUMMARY_FIELDS = [STORED_FIELDS[0], *DIGEST_FIELDS, *FEATURE_FIELDS[:3], T.StructField("tile_sha256", T.StringType())]


def summarize_texts(df: DataFrame, text: str = "text", form: str = "pgm") -> DataFrame:
    """``df`` with digests and features of the image that each whole text makes, in one pass that keeps no image."""

    def one(raw: bytes) -> tuple:
        stored = bytes_to_image(padded(raw), form)
        image = decode(stored)
        height, width, feature, tile = _features(image)
        return len(raw), *_digest(stored, image), height, width, feature, hashlib.sha256(tile).hexdigest()

    return with_arrow_columns(df, text, SUMMARY_FIELDS, lambda batch: _columns([one(r or b"") for r in batch.column(text).cast(pa.large_binary()).to_pylist()], SUMMARY_FIELDS))

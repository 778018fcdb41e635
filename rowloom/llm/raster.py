"""Media columns: Netpbm and BMP images, area-resized, as NPY tiles with difference hashes.

``decode`` reads PGM and PPM (plain and raw, 8 and 16 bits), PBM (plain and raw), and uncompressed
BMP (8-bit palette or grey, 16, 24 and 32 bits, with masks too, either row order) into numpy arrays. ``area_resize``
means over exact source areas by an integral image, so its cost does not depend on the scale.
``tile`` is the NPY serialisation of the resized array, ``difference_hash`` compares neighbours
in a 9 x 8 grey tile.

``text_images`` stores texts as images: bytes padded with spaces to rows of 192, which are the 64 RGB
pixels of a raw PPM row; images are lossless, and features come from the decoded image.

Defined cases: null and empty texts are stored as one row of spaces; long texts give tall images,
processed in strips of bounded height; media that can't be decoded give null features and the
reason (``decode_column``), never an error; repeated rows give equal values, and nothing is ranked, so there are no ties; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, WIDTH, CHANNELS = 192, 64, 3
TILE = (16, 16)  # rows, columns
STRIP = 4096  # source rows whose integral image is held at once


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Raw PGM or PPM of an 8-bit array (rows, columns[, 3])."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Bottom-up 24-bit BMP of an 8-bit RGB array."""
    h, w = pixels.shape[:2]
    pad = -(w * 3) % 4
    body = np.zeros((h, w * 3 + pad), dtype=np.uint8)
    body[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


_SPACE = re.compile(rb"(?:\s|#[^\n]*\n?)+")
_NUMBER = re.compile(rb"\d+")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        skip = _SPACE.match(data, at)
        if not skip or not (m := _NUMBER.match(data, skip.end())):
            raise ValueError("netpbm header")
        head.append(int(m[0]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not 0 < top < 65536 or not w or not h:
        raise ValueError("netpbm range")
    deep = 3 if kind in (3, 6) else 1
    n = w * h * deep
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]
        if bits.strip(b"01"):
            raise ValueError("netpbm bits other than 0 and 1")
        flat = np.frombuffer(bits, dtype=np.uint8) - 48
    elif kind in (2, 3):
        samples = re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]
        if not all(x.isdigit() and len(x) < 6 for x in samples):
            raise ValueError("netpbm samples that are no numbers")
        flat = np.array([int(x) for x in samples], dtype=np.uint32)
    elif kind == 4:
        rows = np.frombuffer(data, dtype=np.uint8, offset=at + 1, count=h * ((w + 7) // 8)).reshape(h, -1)
        flat = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, dtype=np.uint8 if top < 256 else ">u2", offset=at + 1, count=n)
    if len(flat) != n:
        raise ValueError("netpbm is cut short")
    if kind not in (1, 4) and flat.max() > top:
        raise ValueError("netpbm samples out of range")
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif top != 255:
        flat = (flat.astype(np.uint32) * 255 + top // 2) // top
    out = flat.astype(np.uint8, copy=False)
    return out.reshape((h, w, 3) if deep == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40 or packed not in (0, 3) or bits not in (8, 16, 24, 32) or (packed and bits not in (16, 32)) or w <= 0 or h == 0:
        raise ValueError("bmp kind")
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, offset=start, count=abs(h) * step).reshape(abs(h), step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, dtype=np.uint8, offset=14 + size, count=4 * used).reshape(-1, 4)[:, 2::-1]
        return palette[rows]
    if packed or bits == 16:
        # Masks stand behind the first 40 bytes of the header, whether they belong to it or follow it.
        masks = struct.unpack_from("<III", data, 54) if packed else (0x7C00, 0x3E0, 0x1F)
        return _masked(np.ascontiguousarray(rows).view(f"<u{bits // 8}"), masks)
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def _masked(values: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """Samples under masks of adjoining bits, stretched to 8 bits."""
    out = np.empty((*values.shape, 3), dtype=np.uint8)
    for k, mask in enumerate(masks):
        low = mask & -mask
        if not mask or (mask // low) & (mask // low + 1) or mask >= 1 << 8 * values.itemsize:
            raise ValueError("bmp masks")
        top = mask // low
        out[..., k] = ((values & mask).astype(np.uint64) // low * 255 + top // 2) // top
    return out


def decode(data: bytes) -> np.ndarray:
    """uint8 array (rows, columns) or (rows, columns, 3); ValueError for anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError, ZeroDivisionError, MemoryError, TypeError) as e:
        raise ValueError(f"image is cut short or its header wrong: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def _along(image: np.ndarray, n: int) -> np.ndarray:
    """Sums over n equal parts of the first axis, by its integral; parts may cut elements. The integral
    is carried from strip to strip, and read only at the cuts."""
    size = image.shape[0]
    cuts = np.arange(n + 1) * (size / n)
    whole = np.minimum(np.floor(cuts).astype(np.int64), size - 1)
    out = np.empty((n + 1, *image.shape[1:]))
    carried = np.zeros(image.shape[1:])
    for first in range(0, size, STRIP):
        part = image[first : first + STRIP].astype(np.float64)
        integral = np.concatenate([carried[None], carried + np.cumsum(part, axis=0)])
        here = np.flatnonzero((whole >= first) & (whole < first + len(part)))
        k = whole[here] - first
        rest = (cuts[here] - whole[here]).reshape(-1, *[1] * (image.ndim - 1))
        out[here] = integral[k] + rest * part[k]
        carried = integral[-1]
    return np.diff(out, axis=0)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the source area of each target pixel; float64."""
    sums = _along(image, rows)
    sums = np.moveaxis(_along(np.moveaxis(sums, 1, 0), columns), 0, 1)
    return sums * (rows * columns / (image.shape[0] * image.shape[1]))


def tile(image: np.ndarray, shape: tuple[int, int] = TILE) -> bytes:
    """NPY bytes of the image at the tile's size, 8 bits a sample."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, *shape) + 0.5).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 8 means is under its right neighbour's."""
    grey = area_resize(image, 8, 9)
    grey = grey if grey.ndim == 2 else grey @ np.array([0.299, 0.587, 0.114])
    # Means that are equal up to rounding count as equal.
    return np.packbits(np.diff(grey, axis=1) > 1e-6).tobytes().hex()


def text_to_image(text: str | None, form: str = "ppm") -> tuple[int, bytes]:
    """(bytes before padding, the stored image)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    payload = raw + b" " * (-len(raw) % ROW if raw else ROW)
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, CHANNELS)
    return len(raw), encode_ppm(pixels) if form == "ppm" else encode_bmp(pixels)


def text_images(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an image file."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stored = [text_to_image(t, form) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for n, _ in stored], "media": [m for _, m in stored]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


MADE = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", "tile binary", "problem string"]


def features_of(data: bytes | None, shape: tuple[int, int] = TILE) -> tuple:
    """The columns ``MADE`` of one stored image, from its bytes."""
    if data is None:
        return (None,) * 7 + ("no media",)
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        pixels = decode(data)
    except ValueError as e:
        return (None, None, None, *stored, None, None, str(e))
    raw = np.ascontiguousarray(pixels).tobytes()
    return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), *stored, difference_hash(pixels), tile(pixels, shape), None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in MADE])
    for c in ("payload_bytes", "tail_crc32", "media_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def decode_column(media: DataFrame, keep: list[str], column: str = "media", shape: tuple[int, int] = TILE) -> DataFrame:
    """keep, and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference
    hash), tile (NPY) and problem (null when decoded) of each image."""
    fields = [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[keep].reset_index(drop=True), _frame([features_of(m, shape) for m in b[column]])], axis=1)

    return media.select(*keep, column).mapInPandas(run, ", ".join([*fields, *MADE]))


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", form: str = "ppm", shape: tuple[int, int] = TILE) -> DataFrame:
    """``text_images`` and ``decode_column`` in one step: each text is stored as an image file, and the file's
    bytes are read back where they were made, so images don't travel. doc_id, n_bytes and ``MADE``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, made = [], []
            for t in b["text"]:
                n, media = text_to_image(t, form)
                sizes.append(n)
                made.append(features_of(media, shape))
            yield pd.concat([pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n_bytes": sizes}), _frame(made)], axis=1)

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, " + ", ".join(MADE))

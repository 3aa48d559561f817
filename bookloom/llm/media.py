"""Image columns: Netpbm and BMP to arrays, area resize by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bookloom.llm.frames import plus

#: width and height of a tile; a difference hash compares neighbours in a row and gives (width - 1) * height bits
TILE = (9, 8)
#: a text's payload is padded to a multiple of one 24 x 24 image
SIDE = 24
BLOCK = SIDE * SIDE

_NUMBER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_netpbm(samples: np.ndarray) -> bytes:
    """8-bit samples, (height, width) as P5 or (height, width, 3) as P6."""
    h, w = samples.shape[:2]
    return b"%s\n%d %d\n255\n" % (b"P6" if samples.ndim == 3 else b"P5", w, h) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of samples, (height, width) or (height, width, 3). Bitmaps give 0 for black and 255 for white;
    samples of more than 8 bits are big-endian and give uint16."""
    kind = data[:2]
    if len(kind) < 2 or kind[:1] != b"P" or kind[1:] not in b"123456":
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _NUMBER.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("broken Netpbm header")
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        found = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        flat = np.array(found[:w * h * planes], np.int64).astype(np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = -(-w // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)
        flat = bits[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * planes, at + 1)
    if len(flat) < w * h * planes:
        raise ValueError("Netpbm image is cut off")
    if kind in (b"P1", b"P4"):
        flat = np.where(flat, 0, 255).astype(np.uint8)
    return flat.reshape((h, w, 3) if planes == 3 else (h, w))


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit samples as an uncompressed BMP, bottom row first: (height, width) with a grey palette or (height, width, 3)."""
    h, w = samples.shape[:2]
    colour = samples.ndim == 3
    row = samples[::-1, :, ::-1].reshape(h, -1) if colour else samples[::-1]
    pad = -row.shape[1] % 4
    body = np.pad(row, ((0, 0), (0, pad))).tobytes()
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    if not colour:
        palette[:, 3] = 0
        palette = palette.tobytes()
    start = 54 + len(palette)
    words = lambda size, *v: b"".join(int(x).to_bytes(size, "little", signed=x < 0) for x in v)
    return (b"BM" + words(4, start + len(body), 0, start, 40, w, h) + words(2, 1, 24 if colour else 8)
            + words(4, 0, len(body), 2835, 2835, 0 if colour else 256, 0) + palette + body)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: (height, width) if its palette is grey, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    whole = lambda at, size, signed=False: int.from_bytes(data[at:at + size], "little", signed=signed)
    start, header, w, h = whole(10, 4), whole(14, 4), whole(18, 4, True), whole(22, 4, True)
    bits, packed, colours = whole(28, 2), whole(30, 4), whole(46, 4)
    if header < 40 or packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("this kind of BMP is not read")
    row, tall = (w * bits + 31) // 32 * 4, abs(h)
    if len(data) < start + row * tall:
        raise ValueError("BMP image is cut off")
    lines = np.frombuffer(data, np.uint8, row * tall, start).reshape(tall, row)
    lines = lines[::-1] if h > 0 else lines
    if bits >= 24:
        return lines[:, :w * bits // 8].reshape(tall, w, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        index = lines[:, :w]
    else:
        split = np.unpackbits(lines, axis=1).reshape(tall, -1, bits)
        index = (split @ (1 << np.arange(bits)[::-1]))[:, :w]
    palette = np.zeros((1 << bits, 4), np.uint8)
    given = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:1 << bits]
    palette[:len(given)] = given
    used = palette[index][:, :, 2::-1]
    return used[:, :, 0].copy() if (palette[:, :1] == palette[:, 1:3]).all() else used.copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the source area under each target pixel, by differences of an integral image; exact also where a target
    pixel covers parts of source pixels. Colours are averaged to grey first."""
    grey = image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def cut(table: np.ndarray, n: int, size: int) -> np.ndarray:  # the integral at the n + 1 borders, rows first
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(int), size - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corner = cut(cut(total, height, h).T, width, w).T
    return np.diff(np.diff(corner, axis=0), axis=1) * (width * height) / (w * h)


def tile(image: np.ndarray, width: int = TILE[0], height: int = TILE[1]) -> tuple[bytes, str]:
    """The resized image as NPY bytes (uint8) and its difference hash as hexadecimal digits: one bit for each pair of
    neighbours in a row, 1 where the right one is brighter."""
    top = 257.0 if image.dtype.itemsize == 2 else 1.0
    small = np.rint(area_resize(image, width, height) / top).clip(0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, small, allow_pickle=False)
    bits = np.packbits((small[:, 1:] > small[:, :-1]).reshape(-1))
    return out.getvalue(), bits.tobytes().hex()


def media_tiles(df: DataFrame, media: str = "media", width: int = TILE[0], height: int = TILE[1]) -> DataFrame:
    """Add width, height, channels, npy (the tile) and dhash of an image column, and `problem`.

    A null, an empty or an unreadable image gets nulls and the reason in `problem`; no row is lost. Equal images get equal
    values. Other columns are kept; a column with the name of an added one is replaced.
    """
    added = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("npy", pa.binary()),
                       ("dhash", pa.string()), ("problem", pa.string())])
    base = df.drop(*added.names)

    def look(data) -> tuple:
        if not data:
            return None, None, None, None, None, "no image"
        try:
            image = decode(data)
            if not image.size:
                return None, None, None, None, None, "no pixels"
        except ValueError as e:
            return None, None, None, None, None, str(e)
        npy, dhash = tile(image, width, height)
        return image.shape[1], image.shape[0], 3 if image.ndim == 3 else 1, npy, dhash, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [look(x.as_py()) for x in b.column(media)]
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *added.names])

    return base.mapInArrow(run, plus(base, "width int, height int, channels int, npy binary, dhash string, problem string"))


def payload(text: bytes) -> np.ndarray:
    """The bytes of a text, padded with 255 to a positive multiple of the block, as rows of 24 samples."""
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return np.frombuffer(text + b"\xff" * (size - len(text)), np.uint8).reshape(-1, SIDE)


def text_media(docs: DataFrame, text: str = "text", form: str = "netpbm") -> DataFrame:
    """Add `media`: each text's UTF-8 bytes, padded with 255, stored losslessly as a grey image 24 samples wide (a null
    as the empty text, which is one block of padding), and n_bytes, the bytes before padding. A column of these names
    is replaced. One text at a time is held."""
    store = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            for i in range(b.num_rows):  # a row at a time: media are as large as the texts
                held = b.column(at)[i].as_buffer()  # the bytes as they are, whether or not they are valid UTF-8
                raw = held.to_pybytes() if held is not None else b""
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([len(raw)], pa.int64()), pa.array([store(payload(raw))], pa.binary())],
                    [*row.schema.names, "n_bytes", "media"])

    base = docs.drop("media", "n_bytes")
    return base.mapInArrow(run, plus(base, "n_bytes long, media binary"))


def digests(df: DataFrame, media: str = "media") -> DataFrame:
    """Add payload_bytes, payload_sha256 and tail_crc32 (last 32 bytes) of the samples that are read back from `media`,
    and media_bytes and media_sha256 of its stored form; the media column goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(media)
            rows = []
            for x in b.column(at):
                stored = x.as_py()
                back = decode(stored).tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored),
                             hashlib.sha256(stored).hexdigest()))
            rest = [i for i in range(b.num_columns) if i != at]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in rest], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                [*[b.schema.names[i] for i in rest], *ADDED])

    return df.mapInArrow(run, plus(df.drop(media), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
                                                   "media_sha256 string"))


ADDED = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]


def op8_media(spark, folder: str) -> DataFrame:
    """Every text of `documents` as a Netpbm image, read back, with the difference hash of its tile as feature."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    seen = media_tiles(text_media(docs).drop("text"))
    out = digests(seen.select("doc_id", "n_bytes", "media", "width", "height", "npy", "dhash"))
    return out.select("doc_id", "n_bytes", *ADDED, F.col("dhash").alias("feature"), "width", "height", "npy")

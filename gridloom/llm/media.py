"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, documents, mapped, texts, written

WIDTH = 64
TILE_ROWS = 256
#: Where red, green and blue are in plain 32-bit pixels; fixed value.
PLAIN_MASKS = struct.pack("<III", 0xFF0000, 0xFF00, 0xFF)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A binary 8-bit graymap."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of rows x columns (x 3 for colour), uint8 or uint16; ValueError where malformed."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header is cut short")
        if not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("the header is malformed")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    top = head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("a size or maximum is out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind in (b"P4", b"P5", b"P6"):
        at += 1  # one white space ends the header
    if kind == b"P4":
        row = (width + 7) // 8
        if len(data) < at + row * height:
            raise ValueError("pixels are missing")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        return (1 - bits[:, :width]).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        dtype = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) < at + n * dtype.itemsize:
            raise ValueError("pixels are missing")
        flat = np.frombuffer(data, dtype, n, at)
    else:
        rest = re.sub(rb"#[^\n]*", b"", data[at:])
        found = rest.translate(None, b" \t\r\n\v\f")[:n] if kind == b"P1" else rest.split()[:n]
        if len(found) < n:
            raise ValueError("pixels are missing")
        if kind == b"P1":
            flat = 49 - np.frombuffer(found, np.uint8).astype(np.int64)  # "1" is black
        else:
            flat = np.array([int(x) if x.isdigit() and len(x) < 9 else -1 for x in found], np.int64)
    if flat.size and (flat.min() < 0 or flat.max() > top):
        raise ValueError("a sample is out of range")
    flat = flat.astype(np.uint8 if top < 256 else np.uint16)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 8-bit BMP with a gray palette, bottom row first."""
    height, width = pixels.shape
    row = (width + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as rows x columns (gray palettes) or x 3 (RGB); ValueError where malformed, for
    compressed ones and for bit masks other than those of plain 32-bit pixels."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    plain = packed == 0 or (packed == 3 and bits == 32 and data[54:66] == PLAIN_MASKS)
    if size < 40 or not plain or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("this kind of BMP isn't supported")
    rows, row = abs(height), (width * bits + 31) // 32 * 4
    if start < 14 + size or len(data) < start + rows * row:
        raise ValueError("pixels are missing")
    body = np.frombuffer(data, np.uint8, rows * row, start).reshape(rows, row)
    if height > 0:
        body = body[::-1]
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    if bits < 8:
        body = np.unpackbits(body, axis=1).reshape(rows, -1, bits)
        body = body @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if used > 1 << bits or 14 + size + 4 * used > start or int(body[:, :width].max()) >= used:
        raise ValueError("the palette has too few colours")
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    out = palette[body[:, :width]]
    return out[:, :, 0].copy() if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(table: np.ndarray, n: int) -> np.ndarray:
    """Values of a cumulative table at n + 1 equal steps of its first axis, linear between entries."""
    at = np.linspace(0, len(table) - 1, n + 1)
    low = np.minimum(at.astype(np.int64), len(table) - 2)
    part = (at - low)[:, None]
    return table[low] * (1 - part) + table[low + 1] * part


def area_resize(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of each target cell's area, fractions of pixels included, by an integral image."""
    table = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    cells = np.diff(np.diff(_edges(_edges(table, rows).T, cols).T, axis=0), axis=1)
    return cells * (rows * cols / gray.size)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is darker than the cell to its right."""
    gray = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    cells = area_resize(gray, 8, 9).round(6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    """Bands of rows as NPY files; read_tiles() joins them again."""
    out = []
    for at in range(0, len(pixels), rows):
        buffer = io.BytesIO()
        np.save(buffer, pixels[at : at + rows], allow_pickle=False)
        out.append(buffer.getvalue())
    return out


def read_tiles(tiles: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(t), allow_pickle=False) for t in tiles])


def payload(text: str, width: int = WIDTH) -> tuple[bytes, int]:
    """UTF-8 with zeros up to a positive multiple of width, and the length without them."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0"), len(raw)


def media_tiles(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rows: int = TILE_ROWS, also: list[str] | None = None) -> DataFrame:
    """Decodes a binary column of Netpbm or BMP files: doc_id, height, width, dhash, tiles (NPY bytes), error, and the columns named
    in also.

    Null, empty or malformed media give null results and the reason in error; nothing is dropped. Rows may share an id or have none."""
    also = also or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data in zip(batch["doc_id"], batch["media"]):
                try:
                    pixels = decode(bytes(data or b""))
                    out.append((key, pixels.shape[0], pixels.shape[1], difference_hash(pixels), npy_tiles(pixels, rows), None))
                except ValueError as e:
                    out.append((key, None, None, None, None, str(e)))
            made = pd.DataFrame(out, columns=["doc_id", "height", "width", "dhash", "tiles", "error"]).astype({"height": "Int64", "width": "Int64"})
            yield pd.concat([made, batch[[f"also{i}" for i in range(len(also))]].reset_index(drop=True)], axis=1)

    kind = lambda c: df.schema[c].dataType.simpleString()
    numbers = [i for i, c in enumerate(also) if kind(c) in ("bigint", "int", "smallint", "tinyint")]
    kept = "".join(f", also{i} {kind(c)}" for i, c in enumerate(also) if i not in numbers)
    rows_in = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"), *[F.col(c).alias(f"also{i}") for i, c in enumerate(also)])
    made = mapped(rows_in, run, f"height long, width long, dhash string, tiles array<binary>, error string{kept}", ("doc_id", *[f"also{i}" for i in numbers]))
    return made.select("doc_id", "height", "width", "dhash", "tiles", "error", *[F.col(f"also{i}").alias(c) for i, c in enumerate(also)])


def store_texts(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each text as the samples of a graymap of that width: doc_id, n_bytes, media. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [payload(t, width) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for _, n in found], "media": [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, width)) for p, _ in found]})

    return mapped(texts(df), run, "n_bytes long, media binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles int, tiles_sha256 string"


def store_tiles(stored: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """The table of NPY tiles and difference hashes of a table of doc_id, n_bytes and media: doc_id, n_bytes, media_bytes,
    media_sha256, dhash, tiles, error. Malformed media keep their row, without tiles."""
    named = stored.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    made = media_tiles(named, rows=rows, also=["n_bytes", "media_bytes", "media_sha256"])
    return written(made.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "dhash", "tiles", "error"), codec="zstd")


def digests(read: DataFrame) -> DataFrame:
    """What the rows of store_tiles() hold, from their tiles; without tiles, nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.tiles is None:
                    out.append((r.doc_id, r.n_bytes, None, None, None, r.media_bytes, r.media_sha256, None, None, None))
                    continue
                tiles = [bytes(t) for t in r.tiles]
                back = read_tiles(tiles).tobytes()
                out.append((r.doc_id, r.n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), r.media_bytes, r.media_sha256, r.dhash, len(tiles), hashlib.sha256(b"".join(tiles)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in DIGESTS.split(", ")]], dtype=object)

    return mapped(read.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "dhash", "tiles"), run, DIGESTS)


def op1_media(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents; a null text counts as empty and is stored as zeros. The stored media are a table in the
    shared folder, their NPY tiles and difference hashes another; all columns come from what is read back from it."""
    stored = written(store_texts(documents(spark, sf_dir)), codec="zstd")
    tiles = store_tiles(stored)
    discard(stored)
    return digests(tiles)

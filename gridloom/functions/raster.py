"""Pictures as arrays of rows in Arrow batches: ink, contrast, masks as PNG, sizes of binary glTF. NumPy, zlib and struct only; a picture is one row."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: The first bytes of a PNG, of a binary glTF and the kinds of its parts; fixed values.
PNG, GLTF, JSON_PART = b"\x89PNG\r\n\x1a\n", b"glTF", 0x4E4F534A


def otsu(gray: np.ndarray) -> int:
    """The level that parts dark from light with the largest variance between both, the first of several; darker ones are ink."""
    n = np.bincount(gray.reshape(-1).astype(np.uint8), minlength=256)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    other = below[-1] - below
    apart = (mass * other - (mass[-1] - mass) * below).astype(float)
    return int(np.argmax(apart * apart / np.maximum(below * other, 1)))


def ink(pixels: Column, width: Column) -> Column:
    """Otsu level, share of ink, contrast (difference of both means over 255) and that difference as it is (apart) of gray levels in rows; null for an empty picture."""

    @F.pandas_udf("level int, ink double, contrast double, apart double")
    def run(p: pd.Series) -> pd.DataFrame:
        out = []
        for row in p:
            g = np.asarray(row if row is not None else [], float)
            if not len(g):
                out.append((None, None, None, None))
                continue
            level = otsu(g)
            dark = g.astype(np.uint8) <= level
            apart = g[~dark].mean() - g[dark].mean() if dark.any() and (~dark).any() else 0.0
            out.append((level, dark.mean(), apart / 255, apart))
        return pd.DataFrame(out, columns=["level", "ink", "contrast", "apart"])

    return run(F.slice(pixels, 1, F.greatest(F.size(pixels), F.lit(0))))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_mask(mask: np.ndarray) -> bytes:
    """A one-bit gray PNG of a mask of booleans."""
    rows = np.packbits(mask.astype(bool), axis=1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", mask.shape[1], mask.shape[0], 1, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode_mask(data: bytes) -> np.ndarray:
    """The mask of such a PNG; ValueError for anything else, a wrong checksum or missing rows."""
    if data[:8] != PNG or len(data) < 33 or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, kind, packed, filtered, laced = struct.unpack(">IIBBBBB", data[16:29])
    if (depth, kind, packed, filtered, laced) != (1, 0, 0, 0, 0) or not 0 < width < 1 << 20 or not 0 < height < 1 << 20:
        raise ValueError("not a one-bit mask")
    at, body = 8, b""
    while at + 12 <= len(data):
        n, part = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(part + chunk)):
            raise ValueError("a checksum is wrong")
        body += chunk if part == b"IDAT" else b""
        at += 12 + n
    row = (width + 7) // 8 + 1
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(body, row * height + 1)
    except zlib.error as e:
        raise ValueError("pixels are malformed") from e
    if len(raw) != row * height or any(raw[::row]):
        raise ValueError("rows are missing or filtered")
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, row)[:, 1:], axis=1)[:, :width].astype(bool)


def mask_png(mask: Column, width: int) -> Column:
    """PNG bytes of an array of booleans in rows of that width; null for a null or ragged one."""
    make = lambda m: None if m is None or not len(m) or len(m) % width else encode_mask(np.asarray(m, bool).reshape(-1, width))
    return F.pandas_udf(lambda s: pd.Series([make(m) for m in s], dtype=object), "binary")(mask)


def png_mask(data: Column) -> Column:
    """The array of booleans of a mask's PNG; null for what is none."""

    def read(d):
        try:
            return None if d is None else decode_mask(bytes(d)).reshape(-1).tolist()
        except ValueError:
            return None

    return F.pandas_udf(lambda s: pd.Series([read(d) for d in s], dtype=object), "array<boolean>")(data)


def gltf_size(data: bytes) -> tuple[float, float, float, int] | None:
    """Width, height, depth and triangles of a binary glTF, by the bounds and counts that its accessors state; None for what is none."""
    if len(data) < 20 or data[:4] != GLTF:
        return None
    n, kind = struct.unpack("<II", data[12:20])
    if kind != JSON_PART or len(data) < 20 + n:
        return None
    try:
        doc = json.loads(data[20 : 20 + n])
        low, high, triangles = np.full(3, np.inf), np.full(3, -np.inf), 0
        for mesh in doc.get("meshes", []):
            for p in mesh["primitives"]:
                at = doc["accessors"][p["attributes"]["POSITION"]]
                low, high = np.minimum(low, at["min"]), np.maximum(high, at["max"])
                triangles += (doc["accessors"][p["indices"]] if "indices" in p else at)["count"] // 3
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    if not np.isfinite(low).all():
        return None
    return (*(high - low).tolist(), triangles)


def gltf_measures(data: Column) -> Column:
    """gltf_size() of a binary column as struct<width, height, depth, triangles>, nulls where it is no binary glTF."""

    @F.pandas_udf("width double, height double, depth double, triangles long")
    def run(s: pd.Series) -> pd.DataFrame:
        found = [gltf_size(bytes(d)) if d is not None else None for d in s]
        return pd.DataFrame([f or (None,) * 4 for f in found], columns=["width", "height", "depth", "triangles"]).astype({"triangles": "Int64"})

    return run(data)

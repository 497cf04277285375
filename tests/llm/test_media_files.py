"""Stored media, tiles and features against plain versions, and malformed files."""

import hashlib
import io
import struct

import numpy as np
import pytest

from gridloom.llm import media


def plain_hash(gray):
    """Cell means by looping over fractions of pixels, then a bit for each cell darker than its right neighbour."""
    h, w = gray.shape
    cells = np.zeros((8, 9))
    for i in range(8):
        for j in range(9):
            total = 0.0
            y1, y2, x1, x2 = i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9
            for y in range(int(y1), min(h, int(np.ceil(y2)))):
                for x in range(int(x1), min(w, int(np.ceil(x2)))):
                    total += float(gray[y, x]) * (min(y2, y + 1) - max(y1, y)) * (min(x2, x + 1) - max(x1, x))
            cells[i, j] = total / ((y2 - y1) * (x2 - x1))
    bits = "".join("1" if cells[i, j + 1] > cells[i, j] + 1e-6 else "0" for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}"


def bmp(bits, width, height, body, palette=b"", packed=0, used=0, masks=b""):
    start = 54 + len(masks) + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packed, len(body), 0, 0, used, 0) + masks + palette + body


GRAY = b"\0\0\0\0\xff\xff\xff\0"
BAD = [
    None, b"", b"P5", b"P7\n", b"P5\n2 2\n255\nx", b"P2\n2 1\n255\n300 -4", b"P1\n2 1\n1x", b"P2\n1 1\nx\n1", b"P5\n99999999999 1\n255\n", b"P2\n1 1\n9\n1_0", b"P5\n1 1\n9\n\x0a",
    bmp(8, 1, 1, b"\xc8\0\0\0", GRAY, used=2), bmp(32, 1, 1, b"\1\2\3\4", packed=3, masks=struct.pack("<III", 0xF00, 0xF0, 0xF)), bmp(8, 1, 1, b"\0\0\0\0", GRAY, used=300), bmp(16, 1, 1, b"\0\0\0\0"), bmp(8, 1, 1, b"\0\0\0\0", GRAY, packed=1, used=2), b"BM" + b"\xff" * 60,
]


def test_features_of_stored_media(spark):
    rng = np.random.default_rng(1)
    pictures = {1: rng.integers(0, 256, (21, 37), dtype=np.uint8), 2: rng.integers(0, 256, (3, 2), dtype=np.uint8), 3: np.zeros((600, 5), np.uint8)}
    rows = [(k, media.encode_pgm(p) if k != 2 else media.encode_bmp(p)) for k, p in pictures.items()] + [(None, media.encode_pgm(pictures[1])), (1, media.encode_bmp(pictures[2]))]
    rows += [(10 + i, b) for i, b in enumerate(BAD)]
    got = media.media_tiles(spark.createDataFrame(rows, "key long, file binary").selectExpr("*", "1 as height"), "key", "file", 256, ["height"]).toPandas()
    assert len(got) == len(rows) and list(got.columns)[-1] == "height"
    for r in got.drop(columns="height").itertuples():
        if r.error is not None:
            assert r.doc_id >= 10 and r.tiles is None and r.dhash is None
            continue
        p = pictures[1] if np.isnan(r.doc_id) else media.read_tiles([bytes(t) for t in r.tiles])
        assert r.dhash == plain_hash(p) and (np.isnan(r.doc_id) or any((p.shape == q.shape) and (p == q).all() for q in pictures.values()))
        assert len(r.tiles) == -(-len(p) // 256) and np.load(io.BytesIO(bytes(r.tiles[0]))).dtype == np.uint8
    assert sorted(got[got["error"].notna()]["doc_id"]) == [10 + i for i in range(len(BAD))]


def test_store_texts(spark):
    rows = [(None, "é" * 100), (1, None), (1, ""), (2, "x" * 5000), (2, "x" * 5000)]
    got = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (k, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], (bytes(r["media"]).split(b"\n", 3)[3].rstrip(b"\0").decode() or (None if r["n_bytes"] == 0 else "")))))):
        raw = (t or "").encode()
        assert r["n_bytes"] == len(raw) and bytes(r["media"]).endswith(raw + b"\0" * (-len(raw) % 64 if raw else 64))


def test_query_with_odd_ids(spark, tmp_path):
    rows = [(None, "a"), (None, None), (5, "b" * 70), (5, "b" * 70)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op1_media(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["feature"] is not None) for r in got) == [(0, 0, True), (0, 1, True), (5, 70, True), (5, 70, True)]
    full = b"b" * 70 + b"\0" * 58
    assert {r["payload_sha256"] for r in got if r["doc_id"]} == {hashlib.sha256(full).hexdigest()}


@pytest.mark.parametrize("bits,row,want", [(1, b"\xa0\0\0\0", [[255, 0, 255]]), (4, b"\x10\x10\0\0", [[255, 0, 255]])])
def test_palettes(bits, row, want):
    assert media.decode(bmp(bits, 3, 1, row, GRAY, used=2)).tolist() == want
    assert media.decode(bmp(32, 1, -1, b"\1\2\3\0", packed=3, masks=media.PLAIN_MASKS)).tolist() == [[[3, 2, 1]]]

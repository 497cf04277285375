"""Every doc_id comes back as it came, beside nulls and beyond what a double holds."""

from collections import Counter

import pytest

from gridloom.llm import infill, lines, media, packing, pieces, quality, shingles, sketches, spans, substrings, windows

BIG = 1152921504606846977
IDS = [BIG, BIG + 2, None, -(1 << 63) + 5, 7]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, f"Text number {i} stands alone. " * (i + 1)) for i, k in enumerate(IDS)], "doc_id long, text string").coalesce(1)


FOUND = {
    "tiles": lambda d: media.digests(media.store_tiles(media.store_texts(d))),
    "packing": lambda d: packing.pack_documents(d, packing.vocabulary_path()),
    "windows": lambda d: windows.pack_windows(d, packing.vocabulary_path()),
    "pieces": lambda d: pieces.decode_pieces(pieces.encode_pieces(d, pieces.model_path()), pieces.model_path()),
    "digests": lambda d: pieces.piece_digests(d, pieces.model_path()),
    "quality": lambda d: quality.quality_scores(d, 0.5),
    "suffixes": substrings.cut_repeats,
    "ngrams": shingles.near_duplicates,
    "lines": lines.dedup_lines,
    "fingerprints": sketches.fingerprints,
    "edited": sketches.edited_pairs,
    "spans": spans.drop_spans,
    "infill": infill.infilled,
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_ids(docs, name):
    got = FOUND[name](docs)
    assert got.schema["doc_id"].dataType.simpleString() == "bigint"
    found = Counter(r["doc_id"] for r in got.collect())
    assert set(found) == set(IDS) and (name == "windows" or found == Counter(IDS))  # windows cut texts


def test_numbers_beside_media(spark):
    rows = spark.createDataFrame([(BIG, b"P5 1 1 255\n\0", BIG + 1), (None, None, None), (BIG + 2, b"?", 3)], "doc_id long, media binary, n long").coalesce(1)
    assert Counter((r["doc_id"], r["n"], r["height"]) for r in media.media_tiles(rows, also=["n"]).collect()) == Counter([(BIG, BIG + 1, 1), (None, None, None), (BIG + 2, 3, None)])


def test_merged_keys(spark):
    rows = sketches.fingerprints(spark.createDataFrame([(1, "some text here")], "doc_id long, text string")).select("fingerprint").first()[0]
    df = spark.createDataFrame([(BIG, rows), (BIG + 2, rows), (None, rows)], "part long, fingerprint string").coalesce(1)
    assert {r["part"] for r in sketches.merged_fingerprints(df, "part").collect()} == {BIG, BIG + 2, None}


def test_session_settings(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spans.drop_spans(docs).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

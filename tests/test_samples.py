"""Files of samples, and jobs that are sent again."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.operators import mutations, samples

SAMPLE = "sample string, group string, image_png binary, walls_png binary, objects_json string, meta_json string"


def test_files_of_samples(spark):
    rows = [("a", "g1", b"\x00\xff", None, "[]", "{}"), ("b", "g1", b"", b"w", None, "{}"), ("c", None, b"x", None, None, "{}"), ("d", "", b"x", None, None, "{}"), ("e", "g2", None, None, None, None)]
    found = samples.checked(samples.files(spark.createDataFrame(rows, SAMPLE)))
    split = ("train",) * 80 + ("validation",) * 10 + ("test",) * 10
    of = split[int.from_bytes(hashlib.sha256(b"g1").digest()[:8]) % 100]
    want = {f"{of}/a/image.png": b"\x00\xff", f"{of}/a/objects.json": b"[]", f"{of}/a/meta.json": b"{}", f"{of}/b/image.png": b"", f"{of}/b/walls.png": b"w", f"{of}/b/meta.json": b"{}"}
    assert {r.path: (r.sha256, r.bytes) for r in found.collect()} == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in want.items()}
    n = {r.split: (r.n_samples, r.n_files, r.bytes) for r in samples.counts(found).collect()}
    assert n == {s: (2, 6, 9) if s == of else (0, 0, 0) for s in ("train", "validation", "test")}
    with pytest.raises(ValueError, match="large"):
        samples.checked(found, 8)


@pytest.mark.parametrize("names, what", [(["a", "a"], "twice"), (["../a"], "name"), (["a\n"], "name"), (["-a"], "name"), ([None], "name"), (["a" * 129], "name")])
def test_bad_samples(spark, names, what):
    rows = [(n, "g", b"x", None, None, None) for n in names]
    with pytest.raises(ValueError, match=what):
        samples.checked(samples.files(spark.createDataFrame(rows, SAMPLE)))


def test_no_samples(spark):
    found = samples.checked(samples.files(spark.createDataFrame([], SAMPLE)))
    assert found.isEmpty() and [r.n_samples for r in samples.counts(found).collect()] == [0, 0, 0]


def test_requeued_jobs(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    rows = [
        ("never", "pending", 0, None, ago(50), None), ("nulls", "running", None, None, None, None), ("fresh", "running", 1, ago(60), ago(60), None), ("late", "running", 1, ago(61), ago(61), None),
        ("doubled", "running", 2, ago(120), ago(200), None), ("due", "running", 2, ago(121), ago(121), None), ("spent", "pending", 3, ago(241), ago(300), None), ("done", "completed", 1, ago(999), ago(999), None),
        ("many", "pending", 90, ago(9999), ago(9999), None), ("last", "pending", 0, None, ago(1), None), ("odd", None, 0, None, ago(9), None),
    ]
    jobs = spark.createDataFrame(rows, "id string, status string, attempts int, requested_at timestamp_ntz, created_at timestamp_ntz, error string")
    got = {r.id: (r.status, r.attempts, r.requested_at, r.error) for r in mutations.requeued(jobs, "id", F.lit(now).cast("timestamp_ntz"), 60, 3, 5).collect()}
    want = {r[0]: (r[1], r[2], r[3], r[5]) for r in rows}
    # null created_at first, then the oldest; "last" is the sixth
    want |= {"nulls": ("running", 1, now, None), "spent": ("failed", 3, ago(241), "RETRY_EXHAUSTED"), "due": ("running", 3, now, None), "late": ("running", 2, now, None), "never": ("pending", 1, now, None)}
    assert got == want

"""Fingerprints of files that are streamed equal those of their bytes."""

import hashlib
import random

import pytest

from barrio.session import settings
from barrio.sources import scans

RND = random.Random(5)
BYTES = RND.randbytes(300_000)
FILES = {
    "random.parquet": BYTES,
    "ends.csv": BYTES + b"\n",
    "blank.csv": b"a\r\n\n\r\n" * 20_000 + b"\n\n",
    "mark.csv": b"\xef\xbb\xbfid;name\n" + b"1;Caf\xc3\xa9\n" * 9_000,
    "marks.csv": b"\xef\xbb\xbf\xef\xbb\xbfid;name" + b"\n1;Caf\xe9" * 9_000,
    "feeds.bin": b"\n" * 100_000,
    "no feed.bin": b"x" * 150_000,
    "packed.csv.gz": BYTES,
    "small.csv": b"\xef\xbb\xbfid\n",
    "100%25+x.csv": BYTES[:99_999],
}
WANT = {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in FILES.items()}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


@pytest.mark.parametrize("whole", [10, 10**9])
def test_fingerprints(spark, folder, whole):
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}):
        got = {r.file: (r.file_hash, r.size_bytes) for r in scans.fingerprints(spark, folder, whole).collect()}
    assert got == WANT


def test_a_file_beyond_the_largest_value(spark, tmp_path):
    """A value holds less than 2 GB; the limit is lowered here, as such a file is too large for a test."""
    (tmp_path / "a.parquet").write_bytes(BYTES)
    with settings(spark, {"spark.sql.sources.binaryFile.maxLength": "100000"}):
        row = scans.fingerprints(spark, str(tmp_path), 100_000).first()
    assert (row.file_hash, row.size_bytes) == WANT["random.parquet"]

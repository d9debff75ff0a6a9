"""File digests: a file is hashed split by split, so no task reads it whole."""

import gzip
import hashlib
import random

import pytest

from tidegauge.sources import digests as H
from tidegauge.sources import files as A


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def contents() -> dict[str, bytes]:
    rng = random.Random(5)
    mark = H.BYTE_ORDER_MARK
    out = {"empty": b"", "newline": b"\n", "newlines": b"\n" * 2500, "crlf": b"a\r\n\r\nb\r", "mark": mark, "mark_newline": mark + b"\n", "marks": mark + b"x\n" + mark + b"y",
           "no_newline": b"z" * 3500, "one run": rng.randbytes(3000).replace(b"\n", b"\0") + b"\n", "edge": b"q" * 999 + b"\n" + b"r" * 1000 + b"\n", "a%20b [1].parquet": b"\xff\xfe\n" * 900}
    out |= {f"bytes_{i}": rng.randbytes(rng.randrange(1, 6000)) for i in range(4)}
    return out | {f"dense_{i}": bytes(rng.choice(b"\n\r\xefa") for _ in range(rng.randrange(1, 4000))) for i in range(4)} | {"packed.gz": gzip.compress(b"text\n" * 500)}


def test_state_goes_on():
    data = random.Random(1).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 500):
        assert H.Sha256(H.Sha256().update(data[:cut]).state()).update(data[cut:]).hexdigest() == hashlib.sha256(data).hexdigest()


def test_digests_of_split_files(spark, tmp_path, small_splits):
    expected = {}
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
        if data:  # Spark's readers do not list empty files
            expected[name] = hashlib.sha256(data).hexdigest()
    (tmp_path / "_hidden").write_bytes(b"x")
    found = A.file_fingerprints(spark, str(tmp_path)).collect()
    assert {r["name"]: r["sha256"] for r in found} == expected


def test_files_larger_than_a_cell(spark, tmp_path):
    """No file has to fit into one value: its largest size is set to 1,000 bytes here, for 2 GB."""
    data = b"line\n" * 1000
    (tmp_path / "one").write_bytes(data)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert A.file_fingerprints(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(data).hexdigest()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_files_given_twice(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"x")
    assert A.file_fingerprints(spark, [str(tmp_path)] * 2).count() == 1
    with pytest.raises(ValueError, match="more than once"):
        A.file_fingerprints(spark, [str(tmp_path), str(tmp_path / "one")])


def test_no_task_reads_a_whole_file(spark, tmp_path, small_splits, monkeypatch):
    data = b"".join(b"line %d\n" % i for i in range(1500))
    (tmp_path / "one").write_bytes(data)
    seen = spark.sparkContext.accumulator(0)
    advance = H._advance

    def counted(due, rows):
        rows = list(rows)
        assert sum(len(r["bytes"]) for r in rows) < 1100
        seen.add(1)
        return advance(due, rows)

    monkeypatch.setattr(H, "_advance", counted)
    assert A.file_fingerprints(spark, str(tmp_path / "one")).first()["sha256"] == hashlib.sha256(data).hexdigest()
    assert seen.value == -(-len(data) // 1000)

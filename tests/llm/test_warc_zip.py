"""Archives: round trip, ZIP directories and edge cases."""

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import warc_zip
from tapewright.llm.common import importable_by_tasks
from tapewright.session import new_path

SCHEMA = "page_id bigint, url string, html string, path int, offset string, length string, payload int"


@pytest.fixture(scope="module", autouse=True)
def tasks(spark):
    importable_by_tasks(spark)


def pages(spark):
    copy, long = "copy " * 40, "é日 " * 200_000
    texts = ["", None, "short", "short", copy, copy, copy, long, "a\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://x/{i}" if i % 3 else None, t, 1, "o", "l", 2) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, None, copy, 1, None, None, None)]


def test_round_trip_of_odd_pages(spark):
    rows = pages(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = warc_zip.round_trip(df, with_payload=True).collect()
    want = sorted(((r[0] is None, r[0] or 0, (r[2] or "").encode()) for r in rows))
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload or b"")) for r in got if r.record_type == "response") == [
        w for w in want if w[2] != ("copy " * 40).encode() or (not w[0] and w[1] == 4)
    ]
    assert len(got) == len(rows)
    for r in got:
        text = next(p[2] or "" for p in rows if p[0] == r.page_id)
        assert r.payload_digest == hashlib.sha256(text.encode()).hexdigest()
        assert r.payload_bytes == len(text.encode())
        revisit = text.startswith("copy") and r.page_id != 4
        assert (r.record_type, r.refers_to) == (("revisit", 4) if revisit else ("response", None))


def test_no_pages(spark):
    assert warc_zip.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reading_takes_as_many_tasks_as_bytes_ask_for(spark):
    """Any border between reads gives the same records."""
    df = spark.range(400).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("html")
    )
    ranges = warc_zip.locate(warc_zip.write_packages(df.repartition(2), new_path(spark, "warc")))
    total = ranges.agg(F.sum("length")).first()[0]
    found = set()
    for read_bytes in (1, total // 7, total * 2):
        records = warc_zip.read_records(ranges, with_payload=False, read_bytes=max(read_bytes, total // 40))
        if read_bytes == total // 7:
            assert records.rdd.getNumPartitions() == -(-total // read_bytes)
        found.add(tuple(sorted((r.page_id, r.payload_digest) for r in records.collect())))
    assert len(found) == 1 and len(found.pop()) == 400


@pytest.mark.parametrize("comment", [b"", b"plain", b"x PK\x05\x06 and more" * 3, b"PK\x05\x06" + b"\0" * 18])
def test_end_record_with_comment(comment):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
        z.comment = comment
    source = pa.BufferReader(raw.getvalue())
    members = warc_zip.central_directory(source)
    assert [m.name for m in members] == ["a", "b"]
    assert warc_zip.read_range(source, warc_zip.data_offset(source, members[1]), 6) == b"second"

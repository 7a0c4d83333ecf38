"""Reading follows the list of what was written, and failures fail."""

import pyarrow.fs as pafs
import pytest

from pactum.llm import warc
from pactum.llm.common import shared_path, stored

PAGES = [(i, "http://a/b", f"<p>{i % 7}" + "x" * 200) for i in range(60)]


@pytest.fixture
def written(spark):
    directory = shared_path(spark, "warc-test")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return directory, stored(warc.write(warc.plan_revisits(pages), directory, 2_000), "warc-test-manifest")


def test_leftovers_of_another_attempt_are_not_read(spark, written):
    directory, manifest = written
    fs, base = pafs.FileSystem.from_uri(directory)
    with fs.open_output_stream(f"{base}/left-over.warc.zst", compression=None) as f:
        f.write(warc.archive([warc.record(1, "u", b"again" * 50, None)]))
    assert sorted(r["page_id"] for r in warc.read_written(manifest, directory).collect()) == list(range(60))
    assert len(warc.read(spark, directory).collect()) == 61


def test_lost_records_are_errors(spark, written):
    directory, manifest = written
    fs, base = pafs.FileSystem.from_uri(directory)
    name = manifest.first()["path"]
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(warc.archive([warc.record(1, "u", b"alone" * 50, None)]))
    assert any(r["error"] and "instead of" in r["error"] for r in warc.read_written(manifest, directory).collect())
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(b"no archive")
    assert any(r["error"] for r in warc.read_written(manifest, directory).collect())


def test_an_error_fails_the_query(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    broken = spark.createDataFrame([(None,) * 7 + ("bad record",)], warc.SCHEMA)
    monkeypatch.setattr(warc, "archive_round_trip", lambda pages: broken)
    with pytest.raises(Exception, match="bad record"):
        warc.page_digests(pages).collect()

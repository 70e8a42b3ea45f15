import hashlib
import tempfile

import pytest
import zstandard

from flagstone.llm import warc
from flagstone.llm.warc import BundleReader, archive, archive_report, parse_records, read_bundles, read_record

SCHEMA = "page_id long, url string, html string, sha1 int"


def pages(spark):
    big = "é" * 700 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://a.org/{i}", f"<p>{i}</p>" * (i * 37 % 400), 1) for i in range(60)]
    rows += [(100, "http://b.org", big, 1), (101, "http://b.org/2\r\nX: y", big, 1), (102, None, big, 1), (103, "u", "short", 1), (104, "u", "short", 1),
             (105, "u", None, 1), (106, "u", "", 1), (None, "u", big, 1), (102, "again", big, 1), (None, "v", "only " * 300, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip_of_records_and_revisits(spark):
    rows, df = pages(spark)
    index, folder = archive(df, frame_bytes=4000, bundle_bytes=20_000)
    got = read_bundles(index, folder).collect()
    assert len(got) == len(rows)
    wanted = {}
    for i, url, html, _ in rows:
        data = (html or "").encode()
        wanted.setdefault((i, hashlib.sha1(data).hexdigest(), len(data)), data)
    for r in got:
        number = r.record_id.removeprefix("<urn:page:").removesuffix(">")
        data = wanted[int(number) if number else None, r.payload_digest, r.payload_bytes]
        assert bytes(r.payload) == (data if r.record_type == "response" else b"")
    report = sorted(((r.page_id, r.record_type, r.refers_to) for r in archive_report(spark, df).collect() if r.page_id is None or r.page_id >= 100), key=str)
    assert report == sorted([
        (100, "revisit", 102), (101, "revisit", 102), (102, "response", None), (102, "response", None), (None, "revisit", 102), (103, "response", None),
        (104, "response", None), (105, "response", None), (106, "response", None), (None, "response", None)], key=str)


def test_seek_one_record_and_plain_zstandard(spark):
    _, df = pages(spark)
    index, folder = archive(df, frame_bytes=4000)
    data = read_record(index, folder, "<urn:page:59>")
    (head, http, payload), = parse_records(data)
    assert head["warc-target-uri"] == "http://a.org/59" and payload.decode() == "<p>59</p>" * (59 * 37 % 400)
    assert int(http["content-length"]) == len(payload) and read_record(index, folder, "<urn:page:777>") is None
    name = index.first()["file"]
    bundle, (fs, path) = BundleReader(folder, name), warc.filesystem(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert whole == b"".join(bundle.frame(i) for i in range(len(bundle.frames))) and len(bundle.frames) > 3


def test_empty_table_and_a_file_without_seek_table(spark):
    _, df = pages(spark)
    assert archive_report(spark, df.limit(0)).collect() == []
    folder = tempfile.mkdtemp()
    with open(f"{folder}/x", "wb") as f:
        f.write(b"no seek table here")
    with pytest.raises(ValueError):
        BundleReader(folder, "x")


def test_text_keys_come_back_unchanged(spark):
    """Empty keys, line breaks, blanks, marks of the encoding itself and very long keys; null stays null."""
    keys = ["", " ", "a\nb", "a\r\n\r\nb", "%", "%41", "a+b c", "<urn:page:x>", "é€😀", "k" * 5000, None, "1"]
    body = "same words " * 200
    df = spark.createDataFrame([(k, "u", body if n % 2 else f"<p>{n}</p>") for n, k in enumerate(keys)], "page_id string, url string, html string")
    got = archive_report(spark, df).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted(keys, key=str)
    longest = max(k for n, k in enumerate(keys) if n % 2 and k is not None)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(k, longest) for n, k in enumerate(keys) if n % 2 and k != longest}

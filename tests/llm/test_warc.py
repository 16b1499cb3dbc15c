"""Archives: exact round trip, seek tables, one record by one frame."""

import glob
import tempfile

import pytest
import zstandard
from pyspark.sql import functions as F

from spectrafield.llm import warc
from spectrafield.llm.warc import base32_sha1, file_system, id_of, name_of, parsed, read_archives, read_records, seek_table, unpacked, write_archives

PAGES = [(1, "http://a/1", "<p>one</p>", "r"), (2, "http://a/2", "<p>one</p>", "r"), (2, "http://a/2", "<p>one</p>", "r"), (3, None, None, "r"), (4, "u\r\nv", "", "r"), (None, "n", "<p>one</p>", "r"), (7, "big", "é" * 400_000, "r"), (8, "w", "x\r\n\r\nWARC/1.1\r\n\r\n", "r")]


@pytest.fixture(scope="module")
def archives(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    pages = spark.createDataFrame(PAGES * 1, "page_id long, url string, html string, row string").repartition(3)
    return folder, write_archives(pages, folder, date="2020-01-01T00:00:00Z")


def test_round_trip(archives):
    _, index = archives
    rows = read_archives(index).collect()
    assert sorted((r["id"] or "", r["payload_digest"]) for r in rows) == sorted(("" if p[0] is None else str(p[0]), base32_sha1((p[2] or "").encode())) for p in PAGES)
    of = {(r["id"], r["record_type"]): r for r in rows}
    assert of["7", "response"]["payload"] == ("é" * 400_000).encode()
    assert of["8", "response"]["payload"] == b"x\r\n\r\nWARC/1.1\r\n\r\n"
    one = [r for r in rows if r["payload_bytes"] == 10]
    assert sorted((r["id"] or "", r["record_type"], r["refers_to"]) for r in one) == [("", "revisit", "2"), ("1", "revisit", "2"), ("2", "response", None), ("2", "revisit", "2")]
    assert of["4", "response"]["refers_to"] is None and of["3", "revisit"]["refers_to"] == "4"


def test_one_record_costs_one_frame(archives):
    _, index = archives
    got = read_records(index.where("id = '8'")).collect()
    assert [r["payload"] for r in got] == [b"x\r\n\r\nWARC/1.1\r\n\r\n"]
    assert len({r["row"] for r in index.collect()}) == len(PAGES)


def test_bundles_are_seekable_and_plain(archives):
    folder, index = archives
    held = {}
    for r in index.collect():
        held.setdefault(r["bundle"], []).append(r)
    assert len(glob.glob(folder.removeprefix("file://") + "/*")) == len(held)
    for uri, rows in held.items():
        system, path = file_system(uri)
        with system.open_input_file(path) as file:
            table = seek_table(file)
            whole = b"".join(unpacked(file, at, size, check) for at, size, _, check in table)
            for r in rows:
                raw = unpacked(file, r["frame_offset"], r["frame_bytes"])
                assert raw[r["start"] : r["start"] + r["length"]].startswith(b"WARC/1.1\r\n") and table[r["frame"]][:2] == (r["frame_offset"], r["frame_bytes"])
            file.seek(0)
            raw = file.read()
        # a decoder that knows nothing of the seek table reads the same
        plain, rest = b"", raw
        while rest:
            if rest[:4] == b"\x5e\x2a\x4d\x18":
                rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
                continue
            one = zstandard.ZstdDecompressor().decompressobj()
            plain += one.decompress(rest)
            rest = one.unused_data
        assert plain == whole and len(list(parsed(whole))) == len(rows)


def test_frames_and_bundles_fill_up(spark, monkeypatch):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 200).alias("html"))
    index = write_archives(pages.coalesce(1), folder)
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("n")).collect()
    assert len(frames) > 10 and all(f["n"] < warc.FRAME_BYTES + 40_000 for f in frames)
    assert read_archives(index).count() == 300
    assert read_records(index.where("id in ('5', '6', '250')")).count() == 3


def test_small_payloads_can_stay(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert sorted((r["id"], r["record_type"]) for r in write_archives(pages, folder, least=3).collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_empty_table(spark):
    index = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), "file://" + tempfile.mkdtemp(prefix="warc-"))
    assert index.count() == 0 and read_archives(index).count() == 0 and read_records(index).count() == 0


def test_names_come_back():
    for id in (None, "", "5", "a b:c<>é\n"):
        assert id_of(name_of(id, 3)) == (id, 3)


def test_a_damaged_frame_is_told(tmp_path):
    bundle = warc.Bundle(f"file://{tmp_path}")
    bundle.add(b"a" * 1000)
    bundle.close()
    system, path = file_system(bundle.uri)
    with system.open_input_file(path) as file:
        (at, size, _, check), = seek_table(file)
        assert unpacked(file, at, size, check) == b"a" * 1000
        with pytest.raises(ValueError, match="checksum"):
            unpacked(file, at, size, check ^ 1)

import hashlib
import struct

import pyarrow as pa
import pytest
import zstandard

from stayscope.llm import warc_dict as w
from stayscope.llm.files import reading

BIG = "<p>same</p>" * 200


def pages():
    rows = [(i, f"http://h/{i}", f"<html>{'text ' * (i % 50)}{i}</html>") for i in range(300)]
    rows += [(1000, "http://a\r\nX: y", BIG), (1001, None, BIG), (1005, "", BIG), (1005, "twice", BIG), (None, "none", BIG)]
    rows += [(2000, "u", "short"), (2001, "u", "short"), (2002, "u", None), (2003, "u", ""), (2004, "é", "日本" * 400)]
    rows += [(None, "n", "x" * 1500), (None, "n", "x" * 1500), (3000, "long", "word " * 100_000)]
    return rows


def brute(rows):
    out = []
    last = {}
    for key, _, html in rows:
        if len((html or "").encode()) >= 1000 and key is not None:
            last[html] = max(last.get(html, key), key)
    for key, _, html in rows:
        data = (html or "").encode()
        other = last.get(html) if len(data) >= 1000 else None
        revisit = other is not None and key != other
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"bytes_per_file": 2000, "sample_bytes": 500, "dictionary_bytes": 1024}])
def test_against_brute_force(spark, limits):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    files = w.write_archives(df, **limits)
    assert sum(r["n_records"] for r in files.collect()) == len(rows)
    got = w.read_archives(files, with_payload=True).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == brute(rows)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    assert {r["url"] for r in got} == {u.replace("\r\n", "%0D%0A") if u else u for _, u, _ in rows}


def test_files_begin_with_their_dictionary(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    (row,) = w.write_archives(df, sample_bytes=50_000, dictionary_bytes=4096).collect()
    with reading(row["path"]) as stream:
        data = stream.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == w.DICTIONARY_FRAME and 0 < size <= 4096 and len(data) == row["n_bytes"]
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ")
    with pytest.raises(ValueError):
        list(w.read_archive(pa.BufferReader(data[:-5])))
    with pytest.raises(ValueError):
        list(w.read_archive(pa.BufferReader(b"12345678")))


def test_few_records_and_none(spark):
    one = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    assert w.read_archives(w.write_archives(one)).count() == 1
    files = w.write_archives(one.limit(0))
    assert files.count() == 0 and w.read_archives(files).count() == 0
